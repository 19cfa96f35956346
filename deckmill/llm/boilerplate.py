"""Lines repeated across one source's documents (problem 5).

1. Lines are parsed into a token tree of fixed depth: the root splits by token
   count, the next ``DEPTH`` levels by the leading tokens; digit runs are slots
   ('#') from the start. Each partition builds its own tree, that is, the nodes
   with the number of its documents below each.
2. Trees are merged by adding the numbers of equal nodes. A document may be in
   several partitions, so the sum is an upper bound of a node's documents: below
   a node with too few, no line can be in enough documents. Such nodes go, and
   with them most lines; only a row for each node and partition was shuffled.
3. Below the nodes that are left, the exact forms are counted by document. A
   node's template has the token where its forms agree and a slot where not.

Lines are removed by their form, so no line goes that merely looks like a
template that covers many documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import small_side
from ..functions.lineage import cut
from ..sources.tables import once

#: Leading tokens that make inner levels of the tree. A deeper tree prunes more and has more nodes.
DEPTH = 5
#: A position in which the lines of a template differ.
SLOT = "*"


def line_form(line: Column) -> Column:
    """Lower case, white space runs as one blank, trimmed, then each run of digits 0-9 as the slot '#'."""
    squeezed = F.trim(F.regexp_replace(F.lower(line), r"(?U)[\s\x1c-\x1f]+", " "))
    return F.regexp_replace(squeezed, "[0-9]+", "#")


def tree_node(form: Column, depth: int = DEPTH) -> Column:
    """The inner node of a form: its token count and its first ``depth`` tokens."""
    tokens = F.length(form) - F.length(F.translate(form, " ", "")) + 1
    return F.xxhash64(tokens, F.substring_index(form, " ", depth))


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, form): the non-empty forms of each row's text blocks, once per row; null blocks and rows have none."""
    pieces = F.split(F.array_join(text, "\n"), "\n")
    forms = F.array_distinct(F.transform(pieces, line_form))
    return docs.select(F.col(doc), F.explode(forms).alias("form")).where("form <> ''")


def sources(pairs: DataFrame, source: str, doc: str) -> DataFrame:
    """Distinct (source, doc) without nulls."""
    return pairs.select(source, doc).where(F.col(source).isNotNull() & F.col(doc).isNotNull()).distinct()


def local_trees(parsed: DataFrame, source: str, doc: str) -> DataFrame:
    """(source, node, n): for each partition the nodes of its tree and the documents below each in this partition.

    parsed: (source, node, doc). What a task holds is bounded by its partition.
    """
    cols = [source, "node", doc]
    schema = T.StructType([parsed.schema[source], parsed.schema["node"], T.StructField("n", T.LongType())])

    def tree(batches):
        import pyarrow as pa

        def distinct(tables):
            return pa.concat_tables(tables).group_by(cols, use_threads=False).aggregate([]).select(cols)

        held, fresh, rows = [], [], 0
        for batch in batches:
            fresh.append(pa.Table.from_batches([batch]).select(cols))
            rows += batch.num_rows
            if rows > max(500_000, sum(t.num_rows for t in held)):
                held, fresh, rows = [distinct(held + fresh)], [], 0
        if held or fresh:
            n = distinct(held + fresh).group_by([source, "node"], use_threads=False).aggregate([([], "count_all")])
            yield from n.select([source, "node", "count_all"]).rename_columns([source, "node", "n"]).combine_chunks().to_batches()

    return parsed.select(*cols).mapInArrow(tree, schema)


def heavy_nodes(docs: DataFrame, membership: DataFrame, source: str, doc: str, text: str, least_docs: int = 5, least_share: float = 0.25, depth: int = DEPTH) -> DataFrame:
    """(source, node, n_most, total) of the merged tree's nodes below which a line can be in enough of the source's documents."""
    totals = membership.groupBy(source).agg(F.count("*").alias("total"))
    parsed = lines(docs, doc, text).select(doc, tree_node(F.col("form"), depth).alias("node")).join(small_side(membership), doc)
    merged = local_trees(parsed, source, doc).groupBy(source, "node").agg(F.sum("n").alias("n_most")).where(F.col("n_most") >= least_docs)
    return merged.join(totals, source).where(F.col("n_most") >= least_share * F.col("total"))


def repeated_lines(docs: DataFrame, membership: DataFrame, source: str, doc: str, text: str, least_docs: int = 5, least_share: float = 0.25, depth: int = DEPTH) -> DataFrame:
    """(source, line, node, n_docs): every form in at least ``least_docs`` and ``least_share`` of a source's documents.

    A document's repeated lines count once, and so do redelivered rows. Empty
    forms and null sources, documents and texts have no part; extra columns are
    ignored; empty tables give no rows.
    """
    membership = cut(membership)
    heavy = cut(heavy_nodes(docs, membership, source, doc, text, least_docs, least_share, depth))
    parsed = lines(docs, doc, text).select(doc, "form", tree_node(F.col("form"), depth).alias("node"))
    below = parsed.join(small_side(heavy.select("node").distinct()), "node", "left_semi").join(small_side(membership), doc)
    below = below.join(small_side(heavy.select(source, "node", "total")), [source, "node"])
    counts = below.select(source, "node", "form", doc, "total").distinct().groupBy(source, "node", "form", "total").agg(F.count("*").alias("n_docs"))
    enough = (F.col("n_docs") >= least_docs) & (F.col("n_docs") >= least_share * F.col("total"))
    return counts.where(enough).select(source, F.col("form").alias("line"), "node", "n_docs")


def templates(found: DataFrame, source: str) -> DataFrame:
    """(source, template, n_lines, n_docs): the repeated lines of each node as one template, and the most documents of a line."""
    tokens = found.select(source, "node", "line", "n_docs", F.posexplode(F.split("line", " ")).alias("i", "token"))
    at = tokens.groupBy(source, "node", "i").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.count("*").alias("n_lines"), F.max("n_docs").alias("n_docs"))
    one = at.select(source, "node", F.struct("i", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(SLOT).alias("t")).alias("t"), "n_lines", "n_docs")
    g = one.groupBy(source, "node").agg(F.array_sort(F.collect_list("t")).alias("t"), F.max("n_lines").alias("n_lines"), F.max("n_docs").alias("n_docs"))
    return g.select(source, F.array_join("t.t", " ").alias("template"), "n_lines", "n_docs")


def without_repeated_lines(docs: DataFrame, key: str, membership: DataFrame, source: str, doc: str, text: str, **limits) -> DataFrame:
    """(key, text): each row's blocks without the lines that are boilerplate in any source of its document, each key once.

    A block left without lines is dropped; null text stays null, an empty array stays empty.
    """
    found = cut(repeated_lines(docs, membership, source, doc, text, **limits))
    per_doc = cut(membership.join(small_side(found.select(source, "line")), source).groupBy(doc).agg(F.collect_set("line").alias("__drop")))
    rows = once(docs.select(key, doc, F.col(text).alias("__t")), key).join(small_side(per_doc), doc, "left")
    kept = F.transform(F.filter("__t", lambda b: b.isNotNull()), lambda b: F.array_join(F.filter(F.split(b, "\n"), lambda p: ~F.array_contains(F.col("__drop"), line_form(p))), "\n"))
    clean = F.when(F.col("__drop").isNull(), F.col("__t")).otherwise(F.filter(kept, lambda b: b != ""))
    return rows.select(key, clean.alias(text))
