"""Scores of texts for abusive, hateful or sexual content: boosted trees over dense features, calibrated.

Texts are first folded to what a reader sees through disguises: look-alike letters, digits for letters, invisible or
separating signs inside words, drawn-out and transposed letters. A word becomes its first letter and the set of its
other letters, which repetition and transposition leave alone. Japanese and Chinese have no blanks between words: there,
known words are found inside runs of letters, and every other character stands for itself.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallaxa.plans.lineage import Cut, cut

#: Words that dictionaries mark as insulting, violent or vulgar in themselves, in the languages of the corpus,
#: in lower case without accents; `group` names people by origin, faith or health, and is no abuse by itself.
WORDS = {
    "slur": """imbecile imbeciles cretin cretins halfwit halfwits dipshit dipshits scumbag scumbags bastard bastards asshole
        assholes dickhead dickheads wanker wankers twat cunt prick douchebag degenerate degenerates bitch whore slut dumbass
        retard trottel versager arschloch wichser abschaum hurensohn schlampe fotze missgeburt depp connard connards abruti
        abrutis encule encules salaud salauds salope batard gilipollas cabron cabrones subnormal imbecil pendejo maricon
        babaca otario arrombado cuzao 馬鹿 バカ クズ ゴミ野郎""",
    "insult": """idiot idiots moron morons fool fools loser losers parasite parasites scum shit stupid dumb worthless brainless
        braindead spineless pathetic disgusting filthy vile repulsive liar liars coward idiotas idiota stupide estupido
        estupida schwein dumm dummer hirnloser widerlicher dreckiger con conne debile pourri cerdo puta mierda asqueroso
        repugnante mentiroso merda burro nojento""",
    "threat": """kill killed murder strangle stab shoot rape umbringen ermorden erschiessen abstechen verrecke verrecken tuer
        creve crever egorger matar mueras muere violar morra morrer 死ね 殺す""",
    "hate": """vermin subhuman subhumans untermenschen ungeziefer vermine""",
    "group": """foreigners immigrants refugees muslims jews blacks gays disabled auslander fluchtlinge juden muslime behinderte
        etrangers immigres arabes juifs extranjeros inmigrantes judios estrangeiros imigrantes judeus 外国人 障害者""",
    "sexual": """nude nudes naked tits cock dick blowjob blowjobs horny fuck fucks fucking fucked sex panties porn cum boobs
        titten ficken nackt nacktbilder geil baise baiser nue seins desnuda follar tetas culo pelada transar セックス 裸""",
    "first": """i me my myself mine we our ich mich mir mein wir je moi mon me yo mi eu meu 私""",
    "second": """you your yours yourself u ur du dir dich dein deine euch ihr tu te toi ton ta tes vous votre ti tus
        vosotros usted ustedes voce teu tua seu あなた お前""",
}
#: Harmless Japanese words that contain one of these.
HARMLESS = "バカンス バカラ 木クズ 糸クズ パンクズ 裸足 裸眼 裸電球 私立 私物 私服"
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсхуіѕјԁһԛмтвкнгαεοικρτυνωıɑ", "aeopcxyisjdhqmtbkhraeoikptuvwia")
#: Signs that stand for letters inside a word.
SIGNS = str.maketrans("01345789$@€", "oieastbgsae")

FEATURES = (
    "learned_top learned_second learned_sum learned_peak learned_terms slur_density insult_density threat_density hate_density "
    "group_density sexual_density slur_sentence insult_sentence threat_sentence hate_sentence group_sentence sexual_sentence "
    "second_density near_second near_first near_group "
    "insult_pair capitals shouting punctuation exclamations disguised starred log_tokens"
).split()

_TWICE_ENCODED = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]{1,3}")
_TAGS = re.compile(r"<[a-zA-Z/][^<>]*+>")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ \t.\-_])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_]|[.\-_][^\W_])")
_INNER = re.compile(r"(?<=[^\W\d_])_(?=[^\W\d_]|\*)")
_SENTENCES = re.compile(r"[.!?;:]+(?=\s|$)|[。！？\n\r]+")
_WORD = re.compile(r"[^\W_]*[*$@€][\w*$@€]*|[^\W_]+")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_ACCENTS = regex.compile(r"[\p{Mn}--[\u3099\u309a]]+", regex.V1)
_SERIAL = re.compile(r"[a-z]{1,3}\d+")
_FOREIGN = re.compile("[\u0131\u0250-\u052f]")
_LONE = re.compile(r"(?<![^\W_])[^\W\d_][ \t.\-_][^\W\d_][ \t.\-_]")
_MARKS = dict.fromkeys(map(ord, "!?*#$@%&_-."))
_SEPARATORS = re.compile(r"[ \t.\-_*]+")
_VOICED = re.compile("[\u3041-\u30ff][\u3099\u309a]")
_BLANKLESS = re.compile("[\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")


_KEYS: dict[str, str] = {}
_ODD: dict[str, tuple[str | None, int, int]] = {}


def word_key(word: str) -> str:
    """What is left of a word under repetition, transposition, signs for letters and stars; remembered for a while."""
    key = _KEYS.get(word)
    if key is None:
        if len(_KEYS) >= 1 << 18:
            _KEYS.clear()
        key = _KEYS[word] = _key_of(word)
    return key


def _odd_word(word: str) -> tuple[str | None, int, int]:
    """Of a word that isn't letters only: its key, its stars, and whether signs stand for letters in it."""
    found = _ODD.get(word)
    if found is None:
        if len(_ODD) >= 1 << 16:
            _ODD.clear()
        if not any(map(str.isalnum, word)):
            found = None, word.count("*"), 0
        else:
            found = _key_of(word), int("*" in word), int(not word.isalnum() or not (word.isdigit() or _SERIAL.fullmatch(word) is not None))
        _ODD[word] = found
    return found


def _key_of(word: str) -> str:
    if word.isdigit() or re.fullmatch(r"[a-z]{1,3}\d{3,}", word):
        return "0"
    if "*" in word:
        bare = word.strip("_")
        return f"{bare[0]}*{bare[-1]}"
    if not word.isalpha():
        word = word.translate(SIGNS)
    return word if len(word) < 3 else word[0] + "".join(sorted(set(word[1:])))


def _repaired(match: re.Match) -> str:
    try:
        return match.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return match.group()


def _unaccented(text: str) -> str:
    """Without combining marks, except the voicing marks of kana, which make other letters."""
    bare = _ACCENTS.sub("", unicodedata.normalize("NFD", text))
    if "\u3099" in bare or "\u309a" in bare:
        bare = _VOICED.sub(lambda m: unicodedata.normalize("NFC", m.group()), bare)
        bare = bare.replace("\u3099", "").replace("\u309a", "")
    return bare


_SMALL, _LARGE = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(text: str) -> tuple[int, int]:
    """Numbers of letters and of capitals."""
    if text.isascii():
        raw = text.encode("ascii")
        rest = len(raw.translate(None, _LARGE))
        return len(raw) - len(raw.translate(None, _SMALL + _LARGE)), len(raw) - rest
    return sum(map(str.isalpha, text)), sum(map(str.isupper, text))


_LISTED = {_unaccented(w) for words in (*WORDS.values(), HARMLESS) for w in words.split() if _BLANKLESS.match(w)}
_PIECE = re.compile("|".join([*sorted(_LISTED, key=lambda w: (-len(w), w)), _BLANKLESS.pattern, _BLANKLESS.pattern.replace("[", "[^") + "+"]))


def fold(text: str) -> tuple[list[list[str]], dict[str, float]]:
    """Sentences as lists of word keys, and what the disguises and the typography were."""
    plain = _TAGS.sub(" ", text) if "<" in text else text
    plain = html.unescape(plain) if "&" in plain else plain
    plain = plain if plain.isascii() else _TWICE_ENCODED.sub(_repaired, plain)
    (letters, upper), disguised = _letters(plain), 0
    if plain.isascii():
        visible, bare = plain, plain.lower()
    else:
        composed = unicodedata.normalize("NFKC", plain)
        visible = _INVISIBLE.sub("", composed)
        disguised += len(composed) - len(visible)
        lower = visible.lower()
        latin = lower
        if _FOREIGN.search(lower) and re.search("[a-z]", lower):
            latin = lower.translate(LOOKALIKES)
            disguised += sum(map(str.__ne__, lower, latin))
        bare = _unaccented(latin)
    joined = _SPACED.sub(lambda m: _SEPARATORS.sub("", m.group()), bare) if _LONE.search(bare) else bare
    disguised += len(bare) - len(joined)
    if "_" in joined:
        joined, inner = _INNER.subn("", joined)
        disguised += inner
    sentences, starred, shouting = [], 0, 0
    blankless = not joined.isascii() and _BLANKLESS.search(joined) is not None
    known = _KEYS.get
    for part in _SENTENCES.split(joined):
        keys = []
        for word in _WORD.findall(part) if not blankless else [p for w in _WORD.findall(part) for p in _PIECE.findall(w)]:
            key = known(word)
            if key is None:
                if word.isalpha():
                    key = word_key(word)
                else:
                    key, stars, signs = _odd_word(word)
                    starred += stars
                    disguised += signs
                    if key is None:
                        continue
            keys.append(key)
        if keys:
            sentences.append(keys)
    for raw in _SENTENCES.split(visible) if upper > 8 else ():
        some, caps = _letters(raw)
        shouting += caps > 8 and caps > 0.7 * some
    n = max(1, len(text))
    return sentences, {
        "capitals": upper / max(1, letters),
        "shouting": float(shouting),
        "punctuation": (len(text) - len(text.translate(_MARKS))) / n,
        "exclamations": float(text.count("!")),
        "disguised": disguised / max(1, sum(map(len, sentences))),
        "starred": float(starred),
    }


#: The kinds that each word key belongs to.
_KINDS_OF: dict[str, tuple[str, ...]] = {}
for _kind, _list in WORDS.items():
    for _key in {word_key(_unaccented(w)) for w in _list.split()}:
        _KINDS_OF[_key] = (*_KINDS_OF.get(_key, ()), _kind)
_COUNTED = ("slur", "insult", "threat", "hate", "group", "sexual")


def terms(keys: list[str]) -> Iterator[str]:
    """Runs of one, two and three word keys of a sentence."""
    yield from keys
    for i in range(len(keys) - 1):
        yield f"{keys[i]} {keys[i + 1]}"
    for i in range(len(keys) - 2):
        yield f"{keys[i]} {keys[i + 1]} {keys[i + 2]}"


def _places(keys: list[str]) -> tuple[list[float], float]:
    """Where each word key of a sentence stands, and the sentence's length: two lone characters count as one word."""
    steps = [0.5 if len(k) == 1 and not k.isascii() and k not in _KINDS_OF and _BLANKLESS.match(k) else 1.0 for k in keys]
    ends = list(accumulate(steps))
    return [e - s for e, s in zip(ends, steps, strict=True)], max(1.0, ends[-1])


class Lexicon:
    """Weights of terms as a tree of word keys, so that a word that begins no term costs one look."""

    def __init__(self, weights: dict[str, float]):
        self.heads: dict[str, list] = {}
        for term, weight in weights.items():
            below, node = self.heads, None
            for key in term.split(" "):
                node = below.setdefault(key, [None, {}])
                below = node[1]
            node[0] = weight

    def weights_in(self, keys: list[str]) -> list[float]:
        """The weights of the different terms of a sentence."""
        found: dict[tuple, float] = {}
        heads = self.heads.get
        for i, key in enumerate(keys):
            node = heads(key)
            if node is None:
                continue
            if node[0] is not None:
                found[(key,)] = node[0]
            for j in range(i + 1, min(i + 3, len(keys))):
                node = node[1].get(keys[j])
                if node is None:
                    break
                if node[0] is not None:
                    found[tuple(keys[i : j + 1])] = node[0]
        return list(found.values())


def dense_features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of FEATURES; all zero for null texts and texts without words."""
    sentences, typed = fold(text) if text else ([], {})
    if not sentences:
        return [0.0] * len(FEATURES)
    tokens = 0.0
    f = dict.fromkeys(FEATURES, 0.0) | typed
    sums: list[float] = []
    second = 0
    totals = dict.fromkeys(_COUNTED, 0)
    kinds_of = _KINDS_OF.get
    for keys in sentences:
        found = lexicon.weights_in(keys)
        sums.append(sum(found))
        if found:
            f["learned_peak"] = max(f["learned_peak"], max(found))
            f["learned_terms"] = max(f["learned_terms"], float(len(found)))
        at_key, length = (range(len(keys)), len(keys)) if all(map(str.isascii, keys)) else _places(keys)
        tokens += length
        places: dict[str, list[float]] = {}
        for i, kinds in enumerate(map(kinds_of, keys)):
            if kinds is not None:
                for kind in kinds:
                    places.setdefault(kind, []).append(at_key[i])
        if not places:
            continue
        you, own, group = places.get("second", []), places.get("first", []), places.get("group", [])
        second += len(you)
        rude = {*places.get("slur", []), *places.get("insult", [])}
        f["insult_pair"] = max(f["insult_pair"], float(sum(i + 1 in rude for i in rude)))
        if own and rude:
            f["near_first"] = max(f["near_first"], 1.0 / min(abs(i - j) + 1 for i in own for j in rude))
        for kind in _COUNTED:
            at = places.get(kind)
            if not at:
                continue
            totals[kind] += len(at)
            f[f"{kind}_sentence"] = max(f[f"{kind}_sentence"], len(at) / math.sqrt(length))
            if kind == "group":
                continue
            if you:
                f["near_second"] = max(f["near_second"], 1.0 / min(abs(i - j) + 1 for i in you for j in at))
            if group:
                f["near_group"] = max(f["near_group"], 1.0 / min(abs(i - j) + 1 for i in group for j in at))
    for kind in _COUNTED:
        f[f"{kind}_density"] = totals[kind] / tokens
    sums.sort(reverse=True)
    f["learned_top"] = sums[0]
    f["learned_second"] = sums[1] if len(sums) > 1 else 0.0
    f["learned_sum"] = sum(sums)
    f["second_density"] = second / tokens
    f["log_tokens"] = math.log1p(tokens)
    return [float(f[name]) for name in FEATURES]


@dataclass(frozen=True)
class AbuseModel:
    """Parameters. About `labelled_rows` judged documents, by hash of their id, are used for fitting; the learned
    lexicon has at most `lexicon_terms` terms. Both bound what is broadcast, whatever the corpus."""

    labelled_rows: int = 60_000
    lexicon_terms: int = 20_000
    least_documents: int = 2
    least_weight: float = 1.0
    folds: int = 5
    trees: int = 30
    depth: int = 4
    step: float = 0.2
    least_leaf: int = 3
    threshold: float = 0.5


def judged(labels: DataFrame, model: AbuseModel) -> Cut:
    """(doc_id, label, votes, fold): the majority of the judgements that are not null; ties are left out.

    Beyond `labelled_rows` documents, a share of them by the hash of their id, so that about as many are left.
    """
    votes = cut(
        labels.where("doc_id is not null and abusive is not null")
        .groupBy("doc_id")
        .agg(F.sum(F.col("abusive").cast("int")).alias("yes"), F.count(F.lit(1)).alias("n"))
        .where("2 * yes <> n")
        .select(
            "doc_id",
            (F.col("yes") * 2 > F.col("n")).cast("double").alias("label"),
            F.abs(2 * F.col("yes") - F.col("n")).cast("double").alias("votes"),
            F.pmod(F.xxhash64("doc_id"), F.lit(model.folds)).cast("int").alias("fold"),
        ),
        "votes",
    )
    total = votes.df.count()
    if total <= model.labelled_rows:
        return votes
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < int(model.labelled_rows / total * (1 << 30))
    kept = cut(votes.df.where(drawn), "judged")
    votes.drop()
    return kept


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for text, label, votes, fold_no in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = {t for keys in fold(text or "")[0] for t in terms(keys)}
            for column, value in zip(out[1:], (label, votes, fold_no), strict=True):
                column += [value] * len(found)
            out[0].extend(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32())],
            names=["term", "label", "votes", "fold"],
        )


def learn_lexicon(texts: DataFrame, model: AbuseModel) -> dict[str, list[float | None]]:
    """Terms that abusive documents have more often: term -> weights, one without each fold and, last, one of all.

    A document's features use the weights learned without its own fold, so that the trees never see a weight that the
    document's own judgement made.
    """
    counts = texts.select("text", "label", "votes", "fold").mapInArrow(
        _term_rows, "term string, label double, votes double, fold int"
    )
    folds = range(model.folds)
    weighed = counts.withColumn("yes", F.col("label") * F.col("votes"))
    wide = weighed.groupBy("term").agg(
        F.sum("label").alias("documents"),
        *[F.sum(F.when(F.col("fold") == k, F.col("yes")).otherwise(0.0)).alias(f"y{k}") for k in folds],
        *[F.sum(F.when(F.col("fold") == k, F.col("votes")).otherwise(0.0)).alias(f"n{k}") for k in folds],
    ).where(F.col("documents") >= model.least_documents)
    base = texts.groupBy("fold").agg(F.sum(F.col("label") * F.col("votes")).alias("y"), F.sum("votes").alias("n")).collect()
    y_of, n_of = {r["fold"]: r["y"] for r in base}, {r["fold"]: r["n"] for r in base}

    def weight(without: int | None):
        kept = [k for k in folds if k != without]
        y_all = sum(y_of.get(k, 0.0) for k in kept) + 1.0
        n_all = sum(n_of.get(k, 0.0) for k in kept) - y_all + 1.0
        y = sum((F.col(f"y{k}") for k in kept), F.lit(0.0))
        n = sum((F.col(f"n{k}") for k in kept), F.lit(0.0)) - y
        odds = F.log((y + 0.1) / (y_all + 0.1)) - F.log((n + 0.4) / max(1.0, n_all))
        return F.when((y > 0) & (odds >= model.least_weight), odds)

    rows = (
        wide.select("term", "documents", *[weight(k).alias(f"w{k}") for k in folds], weight(None).alias("w"))
        .where("w is not null")
        .orderBy(F.desc(F.col("w") * F.sqrt("documents")), "term")
        .limit(model.lexicon_terms)
        .collect()
    )
    return {r["term"]: [*(r[f"w{k}"] for k in folds), r["w"]] for r in rows}


def featurize(rows: DataFrame, lexicon: dict[str, list[float | None]], model: AbuseModel) -> DataFrame:
    """Adds `dense` to rows with text and fold; a null fold stands for a document to be scored."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = [Lexicon({t: w[k] for t, w in shared.value.items() if w[k] is not None}) for k in range(model.folds + 1)]
        for texts, folds in batches:
            values = [
                dense_features(t, tables[model.folds if k is None else k])
                for t, k in zip(texts.to_pylist(), folds.to_pylist(), strict=True)
            ]
            flat = np.array(values, dtype=np.float64).ravel()
            ends = np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def dense(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    return rows.withColumn("dense", F.arrow_udf(dense, "array<double>")(F.col("text"), F.col("fold")))


@dataclass
class Scored:
    """`rows`: doc_id, score (a calibrated probability), abusive (score at or above the threshold), and the columns kept."""

    rows: DataFrame
    held: list[Cut]


def _quarters(train: DataFrame) -> DataFrame:
    """Adds `fits` and `tunes`: of each kind of judgement, every fourth document by hash is kept from the trees and
    tunes the calibration; a single document of a kind does both."""
    kind = Window.partitionBy("label")
    place = F.row_number().over(kind.orderBy(F.xxhash64(F.col("doc_id"), F.lit("calibration")), "doc_id")) - 1
    placed = train.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(kind))
    alone = F.col("n") == 1
    return placed.withColumn("tunes", alone | (F.col("place") % 4 == 0)).withColumn("fits", alone | (F.col("place") % 4 != 0)).drop("place", "n")


def score_texts(documents: DataFrame, labels: DataFrame, model: AbuseModel | None = None, keep: Sequence[str] = ()) -> Scored:
    """A score for every row of `documents` (doc_id, text), from the judgements in `labels` (doc_id, abusive).

    Null, empty and wordless texts score 0 and are never abusive; repeated rows each get their score; judgements that
    are null, tied, or of documents that are not there have no effect; of other columns only those in `keep` pass
    through. The same trees and calibration are fitted from however few judgements; without judgements of both kinds
    there is nothing to fit: scores of texts with words are null, and no document is a case. A quarter of the judged
    documents of each kind is kept from the trees and calibrates their scores by isotonic regression.
    """
    model = model or AbuseModel()
    kept = [f"__kept_{i}" for i in range(len(keep))]
    texts = documents.select("doc_id", "text", *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    result = ["doc_id", "score", "abusive", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)]]
    votes = judged(labels, model)
    train = cut(_quarters(texts.select("doc_id", "text").join(votes.df, "doc_id").dropDuplicates(["doc_id"])), "judged")
    votes.drop()
    empty = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    if train.df.select("label").distinct().count() < 2:
        train.drop()
        unknown = texts.withColumn("score", F.when(empty, 0.0)).withColumn("abusive", F.lit(False))
        return Scored(unknown.select(*result), [])
    lexicon = learn_lexicon(train.df, model)
    ready = cut(featurize(train.df, lexicon, model).withColumn("features", array_to_vector("dense")), "ready")
    train.drop()
    trees = GBTClassifier(
        labelCol="label", weightCol="votes", maxIter=model.trees, maxDepth=model.depth, stepSize=model.step,
        minInstancesPerNode=model.least_leaf, subsamplingRate=0.8, seed=17,
    ).fit(ready.df.where("fits"))
    margin = vector_to_array("rawPrediction")[1]
    tuned = trees.transform(ready.df.where("tunes")).select("label", "votes", margin.alias("margin"))
    stairs = IsotonicRegression(labelCol="label", weightCol="votes", featuresCol="margin", predictionCol="score").fit(tuned)
    ready.drop()
    every = featurize(texts.withColumn("fold", F.lit(None).cast("int")), lexicon, model)
    marked = trees.transform(every.withColumn("features", array_to_vector("dense"))).withColumn("margin", margin)
    scored = stairs.transform(marked.select("doc_id", "text", *kept, "margin"))
    scored = scored.withColumn("score", F.when(empty, 0.0).otherwise(F.col("score"))).withColumn("abusive", F.col("score") >= model.threshold)
    return Scored(scored.select(*result), [])
