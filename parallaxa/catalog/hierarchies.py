"""Reconstruction lineages as hierarchies."""

from pyspark.sql import functions as F

from parallaxa.operators.hierarchy import build_hierarchy, descendants_of, hierarchy_paths
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()

_WALK = """
WITH RECURSIVE own AS (
  SELECT reconstruction_id AS id, base_reconstruction_id AS parent FROM incremental_reconstructions
  UNION ALL SELECT base_reconstruction_id, NULL FROM incremental_reconstructions
), links AS (SELECT id, min(parent) AS parent FROM own WHERE id IS NOT NULL GROUP BY id),
tree AS (
  SELECT id, id AS root, 0::BIGINT AS depth, [id] AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.id, t.root, t.depth + 1, list_append(t.path, l.id) FROM tree t JOIN links l ON l.parent = t.id
), loose AS (SELECT * FROM links WHERE id NOT IN (SELECT id FROM tree)),
trail AS (
  SELECT id AS start_id, id AS pos, 0::BIGINT AS steps FROM loose
  UNION ALL
  SELECT s.start_id, l.parent, s.steps + 1 FROM trail s JOIN loose l ON l.id = s.pos
  WHERE s.steps < (SELECT count(*) FROM loose)
), on_cycle AS (SELECT DISTINCT start_id AS id FROM trail WHERE steps > 0 AND pos = start_id),
ring AS (SELECT start_id AS id, min(pos) AS root FROM trail WHERE start_id IN (SELECT id FROM on_cycle) GROUP BY 1),
hang AS (
  SELECT id, id AS top, 0::BIGINT AS depth, [id] AS path FROM on_cycle
  UNION ALL
  SELECT l.id, h.top, h.depth + 1, list_append(h.path, l.id)
  FROM hang h JOIN loose l ON l.parent = h.id WHERE l.id NOT IN (SELECT id FROM on_cycle)
), nodes AS (
  SELECT id, root, depth, 'tree' AS state, path FROM tree
  UNION ALL
  SELECT h.id, r.root, h.depth, CASE WHEN h.depth = 0 THEN 'cycle' ELSE 'below_cycle' END, h.path
  FROM hang h JOIN ring r ON r.id = h.top
)
"""


@REGISTRY.query(
    "p2_found", _WALK + "SELECT id AS reconstruction_id, root AS root_reconstruction_id, depth, state FROM nodes"
)
def p2_found(spark, sf_dir):
    links = table(spark, sf_dir, "incremental_reconstructions").select("reconstruction_id", "base_reconstruction_id")
    tree = build_hierarchy(links, "reconstruction_id", "base_reconstruction_id")
    return tree.nodes.select(
        F.col("id").alias("reconstruction_id"), F.col("root").alias("root_reconstruction_id"), "depth", "state"
    )


@REGISTRY.query(
    "p2_hierarchy",
    _WALK
    + """, sizes AS (SELECT a AS id, count(*) - 1 AS descendants FROM (SELECT unnest(path) AS a FROM nodes) GROUP BY 1)
SELECT n.id AS reconstruction_id, root AS root_reconstruction_id, depth, state, array_to_string(path, '/') AS path,
  (row_number() OVER (ORDER BY path) - 1)::BIGINT AS preorder_start, s.descendants::BIGINT AS descendants
FROM nodes n JOIN sizes s ON s.id = n.id""",
)
def p2_hierarchy(spark, sf_dir):
    """Path from the first reconstruction, and the nested-set range that holds all that was built on each."""
    links = table(spark, sf_dir, "incremental_reconstructions").select("reconstruction_id", "base_reconstruction_id")
    tree = build_hierarchy(links, "reconstruction_id", "base_reconstruction_id")
    return tree.nodes.join(hierarchy_paths(tree), "id").select(
        F.col("id").alias("reconstruction_id"),
        F.col("root").alias("root_reconstruction_id"),
        "depth",
        "state",
        F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"),
        F.col("start").alias("preorder_start"),
        "descendants",
    )


@REGISTRY.query(
    "p2_descendants",
    _WALK
    + """SELECT a AS reconstruction_id, id AS descendant_id FROM (SELECT id, unnest(path) AS a FROM nodes) WHERE a <> id""",
)
def p2_descendants(spark, sf_dir):
    """All that was built on each reconstruction, directly or not, by the nested-set ranges."""
    links = table(spark, sf_dir, "incremental_reconstructions").select("reconstruction_id", "base_reconstruction_id")
    tree = build_hierarchy(links, "reconstruction_id", "base_reconstruction_id")
    return descendants_of(tree).withColumnRenamed("ancestor_id", "reconstruction_id")
