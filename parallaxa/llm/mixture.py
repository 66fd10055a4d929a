"""Mixing sources to target weights: soft membership, fitted document rates, whole copies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parallaxa.llm.bpe import TOKENIZER_DIR, token_count
from parallaxa.operators.prefix import prefix_sum
from parallaxa.plans.lineage import Cut, cut


@dataclass(frozen=True)
class MixModel:
    """Parameters. The two classifiers are fitted on about `labelled_rows` documents with a source in all, drawn by hash
    of their id, over `hashed_words` features, in `fit_partitions` tasks. `steps` bounds the projected-gradient steps;
    `soft_weight` is the weight of the predicted domain totals beside those of the known sources."""

    labelled_rows: int = 20_000
    hashed_words: int = 4096
    regularisation: float = 0.01
    fit_rounds: int = 12
    fit_partitions: int = 2
    steps: int = 8
    tolerance: float = 1e-4
    soft_weight: float = 1.0
    tokenizer: str = "byte_bpe_50k"
    folder: str = TOKENIZER_DIR


@dataclass
class Mixture:
    """`copies`: doc_id, source (null where unknown), tokens, rate, copies, for every document of these with tokens.
    `shares`: the targets and what was reached, one row for each source of the weights."""

    copies: DataFrame
    shares: DataFrame
    held: list[Cut]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def domain_posteriors(texts: DataFrame, domains: list[str], model: MixModel) -> Cut:
    """(doc_id, tokens, domain, membership, predicted), arrays over `domains`.

    `predicted` is the posterior of every domain by a multinomial classifier, for every document: the documents fall
    into two halves by hash, each half with a classifier that was fitted on documents of known domain in the other.
    `membership` is the known domain where there is one, else the posterior.
    """
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=model.hashed_words)
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)).cast("int")
    by_domain = {r["domain"]: r["count"] for r in texts.where("domain is not null").groupBy("domain").count().collect()}
    present = sorted(by_domain)  # at most the domains given
    number = F.array_position(F.array(*[F.lit(d) for d in present]), F.col("domain")).cast("double") - 1
    share = min(1.0, model.labelled_rows / max(1, sum(by_domain.values())))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) <= int(share * (1 << 30))
    labelled = texts.where("domain is not null").where(drawn).select(half.alias("half"), _words(F.col("text")).alias("words"), number.alias("label"))
    train = cut(labelled.coalesce(model.fit_partitions), "labelled")
    kinds = {h: sorted(r["label"] for r in train.df.where(F.col("half") == h).select("label").distinct().collect()) for h in (0, 1)}
    known = F.array(*[(F.col("domain") == d).cast("double") for d in domains])
    parts = []
    for h in (0, 1):
        mine, other = texts.where(half == h), train.df.where(F.col("half") == 1 - h)
        if len(kinds[1 - h]) < 2:  # nothing to tell apart: all mass on what there is, in proportion
            total = max(1, sum(by_domain.values()))
            predicted = F.array(*[F.lit(by_domain.get(d, 0) / total) for d in domains])
            guessed = mine
        else:
            classifier = LogisticRegression(family="multinomial", regParam=model.regularisation, maxIter=model.fit_rounds).fit(hashing.transform(other))
            ready = mine.select("doc_id", "tokens", "domain", _words(F.col("text")).alias("words"))
            guessed = classifier.transform(hashing.transform(ready)).withColumn("p", vector_to_array("probability"))
            # a class beyond the largest met in the sample has no probability; nor has a source without documents
            predicted = F.array(*[F.coalesce(F.get("p", F.lit(present.index(d))), F.lit(0.0)) if d in by_domain else F.lit(0.0) for d in domains])
        parts.append(guessed.select("doc_id", "tokens", "domain", predicted.alias("predicted")))
    both = parts[0].unionByName(parts[1])
    membership = F.when(F.col("domain").isNotNull(), known).otherwise(F.col("predicted"))
    result = cut(both.select("doc_id", "tokens", "domain", membership.alias("membership"), "predicted"), "posteriors")
    train.drop()
    return result


@dataclass
class Rates:
    """Document rates as the moves that lead to them from a first rate: gradient steps to add, factors to multiply by.
    Rates are not stored; every pass replays the few moves so far, for many rows at a time."""

    size: int
    first: np.ndarray
    moves: list[tuple[str, np.ndarray]]

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(rate, both memberships side by side) of each row."""
        e = np.frombuffer(b"".join(batch.column("mass").to_pylist()), dtype=np.float64).reshape(batch.num_rows, 2 * self.size)
        known = e[:, : self.size]
        cap = batch.column("cap").to_numpy(zero_copy_only=False).astype(float)
        rate = cap * np.clip(known @ self.first, 0, 1)
        for kind, move in self.moves:
            rate = np.clip(rate + e @ move if kind == "add" else rate * (known @ move), 0, cap)
        return rate, e

    def totals(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at these rates by membership and by prediction: one pass, one row from each task."""
        names = [f"s{i}" for i in range(2 * self.size)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(2 * self.size)
            for batch in batches:
                rate, e = self.of(batch)
                sums += (batch.column("tokens").to_numpy() * rate) @ e
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=names)

        partial = rows.select("tokens", "cap", "mass").mapInArrow(run, ", ".join(f"{n} double" for n in names))
        found = partial.agg(*[F.sum(n).alias(n) for n in names]).head()
        both = np.array([x or 0.0 for x in found])
        return both[: self.size], both[self.size :]

    def applied(self, rows: DataFrame) -> DataFrame:
        """Adds `rate` to rows with tokens, cap and mass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(self.of(batch)[0])], names=[*batch.schema.names, "rate"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("rate", "double"))


def packed_masses(rows: DataFrame) -> DataFrame:
    """Adds `mass`: membership and predicted side by side as the bytes of doubles, which the passes read at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            both = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("membership", "predicted")]
            mass = pa.array([row.tobytes() for row in np.concatenate(both, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, mass], names=[*batch.schema.names, "mass"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("mass", "binary"))


def fit_rates(rows: DataFrame, targets: np.ndarray, model: MixModel) -> Rates:
    """Document rates between 0 and the row's `cap`, by distributed projected-gradient least squares.

    Rows have tokens, cap, membership, predicted and mass. The rates start even over every domain's documents. Two sets of
    totals are to match the targets: those of the memberships and, with a smaller weight, those of the predictions. A
    step moves each rate along the scaled residuals and clips it. Each total's scale is one over twice its tokens: as
    both memberships of a row sum to 1 at most, no step can overshoot, and the error falls with every step. The last
    moves scale each domain's rates so that the known sources come out right, whatever the predictions want.
    """
    size = len(targets)
    every = Rates(size, np.ones(size), []).totals(rows)  # tokens at the caps
    sums = rows.agg(*[F.sum(F.col("tokens") * F.col(c)[i]).alias(f"{c}{i}") for c in ("membership", "predicted") for i in range(size)]).head()
    tokens = np.array([x or 0.0 for x in sums])
    rates = Rates(size, np.divide(targets, every[0], out=np.zeros(size), where=every[0] > 0), [])
    scale = np.divide(np.repeat([1.0, model.soft_weight**2], size), 2 * tokens, out=np.zeros(2 * size), where=tokens > 0)
    total = max(1.0, targets.sum())
    for _ in range(model.steps):
        hard, soft = rates.totals(rows)
        move = scale * np.concatenate([targets - hard, targets - soft])
        if np.abs(move).max(initial=0) <= model.tolerance:
            break
        rates.moves.append(("add", move))
    for _ in range(2):
        hard, _ = rates.totals(rows)
        if np.abs(targets - hard).max(initial=0) <= 1e-6 * total:
            break
        rates.moves.append(("scale", np.divide(targets, hard, out=np.zeros(size), where=hard > 0)))
    return rates


def whole_copies(rated: DataFrame) -> Cut:
    """Adds `copies`, each rate rounded down or up, such that the tokens of every source come out as the rates say.

    Systematic rounding runs along the documents of a source in order of length, so that documents of every length are
    kept in proportion. What few long documents leave over is then made up by rounding short ones the other way, in
    order of length, as far as their prefix sum fits.
    """
    order = rated.withColumn("tie", F.xxhash64("doc_id")).withColumn("copy_no", F.monotonically_increasing_id())
    summed, blocks = prefix_sum(order, ["source"], ["tokens", "tie", "copy_no"], "rate", "before")
    before, rate = F.round("before", 9), F.round("rate", 9)
    first = F.least(F.floor(before + rate + 0.5) - F.floor(before + 0.5), F.col("cap").cast("bigint"))
    rounded = cut(summed.where("source is null or source <> ''").withColumn("copies", first), "rounded")
    blocks.drop()
    left = rounded.df.groupBy("source").agg(F.sum(F.col("tokens") * (F.col("rate") - F.col("copies"))).alias("left"))
    owed = rounded.df.join(F.broadcast(left.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    up = (F.col("left") > 0) & (F.col("copies") < F.ceil(rate)) & (F.col("copies") < F.col("cap"))
    down = (F.col("left") < 0) & (F.col("copies") > F.floor(rate))
    step = F.when(up, 1).when(down, -1).otherwise(0)
    loose = owed.withColumn("step", step).withColumn("loose", F.when(F.col("step") != 0, F.col("tokens")).otherwise(0))
    fitted, more = prefix_sum(loose, ["source"], ["tokens", "tie", "copy_no"], "loose", "spent")
    taken = (F.col("step") != 0) & (F.col("spent") + F.col("tokens") / 2 <= F.abs("left"))
    result = cut(
        fitted.withColumn("copies", F.col("copies") + F.when(taken, F.col("step")).otherwise(0)).select(
            "doc_id", "source", "tokens", "membership", "predicted", "rate", "copies"
        ),
        "copies",
    )
    more.drop()
    rounded.drop()
    return result


def _cap(repeats: list[int]) -> Column:
    """The repeats of the likeliest named source (the fewest of equally likely ones); 0 where no named source is possible."""
    if not repeats:
        return F.lit(0.0)
    sides = [F.struct(F.col("membership")[i].alias("p"), F.lit(-float(c)).alias("c")) for i, c in enumerate(repeats)]
    likeliest = F.array_max(F.array(*sides))
    return F.when(likeliest["p"] > 0, -likeliest["c"]).otherwise(0.0)


def mix(documents: DataFrame, weights: DataFrame, model: MixModel | None = None) -> Mixture:
    """Copies of documents such that the sources of `weights` reach their target shares of all tokens.

    `documents`: doc_id, source, text; `weights`: source, target_weight, max_repeats. Sources must be spelled alike.
    Repeated doc_ids are separate records. Documents of sources without a weight are left out. Documents with a null
    source take part by their posterior over the sources, at most as often as the likeliest source with a weight allows;
    how likely they are of none of these lowers their rate, not their cap. Null, empty
    and tokenless texts get no copies. The total is the largest for which no source needs more than its max_repeats;
    a source without documents can't be reached, and the others keep their proportions. `shares` tells what was reached
    by the known sources, by known and predicted sources together, and by the predictions alone. Rates become whole copies by
    systematic rounding along the documents of a source in order of length, so that its tokens come out right too.
    Null or non-positive weights count as 0, null max_repeats as 1.
    """
    model = model or MixModel()
    asked = [
        (r["source"], float(r["w"] or 0.0), int(r["c"] if r["c"] is not None else 1))
        for r in weights.where("source is not null")
        .groupBy("source")
        .agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("c"))
        .orderBy("source")
        .collect()
    ]
    asked = [(s, max(0.0, w), max(0, c)) for s, w, c in asked]
    names = [s for s, _, _ in asked]
    domains = [*names, ""]  # the last stands for every source without a weight
    source = F.col("source")
    domain = F.when(source.isNull(), F.lit(None)).when(source.isin(names), source).otherwise("")
    counted = cut(
        documents.select("doc_id", "source", "text", domain.alias("domain"), token_count(documents, "text", model.tokenizer, model.folder).alias("tokens")),
        "counted",
    )
    posteriors = domain_posteriors(counted.df, domains, model)
    counted.drop()
    rows = cut(packed_masses(posteriors.df.withColumn("cap", _cap([c for _, _, c in asked])).where("tokens > 0")), "members")
    posteriors.drop()
    m, t = F.col("membership"), F.col("tokens").cast("double")
    # what each source could give: its sure and its expected tokens under their caps
    room = rows.df.agg(*[F.sum(t * m[i] * F.col("cap")).alias(f"r{i}") for i in range(len(domains))]).head()
    room = np.array([x or 0.0 for x in room])
    weight = np.array([w for _, w, _ in asked] + [0.0])
    usable = np.where(room > 0, weight, 0.0)
    share = usable / usable.sum() if usable.sum() > 0 else usable
    held = share > 0
    total = float((room[held] / share[held]).min()) if held.any() else 0.0
    rated = fit_rates(rows.df, share * total, model).applied(rows.df).withColumnRenamed("domain", "source").drop("mass")
    copies = whole_copies(rated)
    rows.drop()
    c = copies.df
    given = F.col("copies") * F.col("tokens")
    by_source = {
        r["source"]: r
        for r in c.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(given).alias("mixed"),
            F.count_if(F.col("copies") > 0).alias("used"), F.max("copies").alias("most"),
        )
        .collect()
    }
    sums = c.agg(*[F.sum(given * F.col(by)[i]).alias(f"{by}{i}") for by in ("membership", "predicted") for i in range(len(domains))]).head()
    expected, predicted = sums[: len(domains)], sums[len(domains) :]
    named = sum((r["mixed"] or 0) for s, r in by_source.items() if s is not None)
    soft = sum(x or 0.0 for x in expected[: len(names)])
    guessed = sum(x or 0.0 for x in predicted)
    wanted = float(weight.sum())
    table = []
    for i, (s, w, cap) in enumerate(asked):
        r = by_source.get(s)
        table.append(
            (
                s, w / wanted if wanted else 0.0, float(share[i]), int(r["documents"]) if r else 0, int(r["tokens"]) if r else 0,
                int(r["mixed"] or 0) if r else 0, float(r["mixed"] or 0) / named if r and named else 0.0,
                float(expected[i] or 0.0) / soft if soft else 0.0, float(predicted[i] or 0.0) / guessed if guessed else 0.0, cap, int(r["most"] or 0) if r else 0,
                "no documents" if room[i] <= 0 else "reached" if w > 0 else "no weight",
            )
        )
    shares = documents.sparkSession.createDataFrame(
        table,
        "source string, target_share double, attainable_share double, documents bigint, tokens bigint, mixed_tokens bigint, "
        "reached_share double, expected_share double, predicted_share double, max_repeats int, most_copies int, state string",
    )
    return Mixture(c.select("doc_id", "source", "tokens", "rate", "copies"), shares, [copies])
