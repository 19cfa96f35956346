"""Reading level of each document (problem 9).

Vocabulary: the words of all documents are counted per language, which is told
from the text itself, and ranked by frequency. A document's coverage rank is the
size of the smallest top of that ranking that covers a fixed share of its words.
Sentence complexity is the mean words of a sentence, weighted by length, and the
share of long words. Layout doesn't count: code, tables, headings, paths and
other tokens that aren't words are left out, wrapped lines are joined, list
items and lines without a full stop end a sentence.

The features are centred within their language in SQL, over all documents. For
each level k above the first, a logistic model of "level is k or more" is fitted
on labelled documents (at most ``FIT_ROWS``) and evaluated in SQL over all; a
document's level is one more than the models that give it a half or more.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from ..functions.joins import small_side
from ..functions.lineage import cut
from ..operators.scoring import ranked

#: Share of a document's words that its vocabulary must cover.
COVERAGE = 0.5
#: Ranks of each language that workers are sent; a document whose vocabulary must go further is ranked by a join.
RANKS = 10_000
#: Letters of a long word, and the words of a sentence at which its length stops to count.
LONG_WORD, LONGEST_SENTENCE = 11, 100
#: Levels of the labels.
LEVELS = (1, 2, 3, 4, 5)
#: Labelled documents that the models are fitted on, at most, and the strength of the prior that their slopes are 0.
FIT_ROWS, RIDGE = 20_000, 0.3
#: Frequent function words by which a language in Latin script is told.
FUNCTION_WORDS = {
    "en": "the and of to in is it we for a with that on are be was you can",
    "de": "der die das und ist nicht ein eine wir mit von für auf zu den dem im aus",
    "fr": "le la les des et est une un pour que dans de qui nous du ne pas on",
    "es": "el los las una del que y en es por con para se no al lo un su",
    "pt": "o os as uma que e em para com não do da dos das um no na são",
}
_LANGUAGES_OF = {w: tuple(k for k, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}
#: What may stand around a word, and what a word with more than plain letters looks like.
_AROUND = ".,;:!?…()[]\"'“”„‘’«»‹›¿¡*_-।"
_COMPOUND = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f\u0900-\u0dff'’-])*")
#: A longer sentence is a run-on, and its clauses count as sentences, if one word in RUN_ON_SHARE is a conjunction that strings clauses together.
RUN_ON, RUN_ON_SHARE = 40, 25
#: Fixed values: "and" in the languages told apart.
AND = frozenset("and und et y e и और".split())
#: Scripts that tell a language.
_SCRIPTS = {"hi": re.compile("[\u0900-\u097f]"), "ru": re.compile("[\u0400-\u04ff]")}
_FENCED = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.DOTALL)
#: Lines that aren't prose: headings, table rows, rules, comments of code, link and file lists.
_NOT_PROSE = re.compile(r"^[ \t]*(?:#{1,6} .*|\|.*|[=~_*-]{3,}|(?:\$|>>>|//).*|(?:import|from|def|class|return|const|let|var|function|select)\b.*[(){};=].*|.*[\w/][_/][\w/]+[,;].*[\w/][_/][\w/]+.*)$", re.MULTILINE | re.IGNORECASE)
#: What ends a sentence: a full stop before white space, an empty line, or a line after which no lower-case letter goes on.
_END = re.compile(r"(?<=[.!?…।])[\"'”»)]*\s+|\n\s*\n|\n(?![ \t]*[^\W\d_A-ZÀ-ÖØ-ÞА-Я])")


def words_in(tokens: list[str]) -> list[str]:
    """The tokens that are words, without the punctuation around them."""
    return [w for t in tokens if (w := t if t.isalpha() else t.strip(_AROUND)).isalpha() or _COMPOUND.fullmatch(w)]


def language(body: str) -> str:
    """The language of a whole text's prose: by the script of most of its letters, else by its function words."""
    if not body.isascii():
        for name, script in _SCRIPTS.items():
            n = len(script.findall(body))
            if n and n * 2 > sum(map(str.isalpha, body)):
                return name
    votes: Counter = Counter()
    for t, n in Counter(body.lower().split()).items():
        for k in _LANGUAGES_OF.get(t if t.isalpha() else t.strip(_AROUND), ()):
            votes[k] += n
    return max(votes, key=lambda k: (votes[k], k)) if votes else "other"


def prose(text: str | None) -> str:
    """The text in lower case without the parts that aren't prose."""
    if not text:
        return ""
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n\n", text)
    return _NOT_PROSE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))


def clauses(words: list[str]) -> list[list[str]]:
    """A sentence as it is, or the clauses of a run-on."""
    if len(words) <= RUN_ON or RUN_ON_SHARE * (n := sum(1 for w in words if w in AND)) < len(words):
        return [words]
    out: list[list[str]] = [[]]
    for w in words:
        if w in AND:
            out.append([])
        else:
            out[-1].append(w)
    return [c for c in out if len(c) > 1]


def analysed(text: str | None) -> tuple[str, list[list[str]]]:
    """The language, and the words of each sentence of at least two words."""
    body = prose(text)
    sentences = [s for s in (words_in(x.lower().split()) for x in _END.split(body)) if len(s) > 1]
    sentences = [c for s in sentences for c in clauses(s)]
    return language(body), sentences


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(language, word, n) over all documents; each batch of rows sums up its own first."""
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches):
        totals: dict[str, Counter] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and (tokens := t.lower().split()):
                    totals.setdefault(language(prose(t)), Counter()).update(tokens)
            if sum(map(len, totals.values())) > 200_000:
                yield from flushed(totals)
                totals = {}
        yield from flushed(totals)

    def flushed(totals):
        import pyarrow as pa

        for name, tokens in totals.items():
            n: Counter = Counter()
            for t, k in tokens.items():
                for w in words_in([t]):
                    n[w] += k
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["language", "word", "n"])

    return docs.select(text).mapInArrow(count, schema).groupBy("language", "word").agg(F.sum("n").alias("n"))


def ranking(docs: DataFrame, text: str) -> DataFrame:
    """(language, k, word, r): the rank of every word of each language by frequency; ties go by the word. Cut.

    Words are spread over ranges, so that no task ranks a whole language.
    """
    keyed = counted(docs, text).select("language", (-F.col("n")).alias("k"), "word")
    return cut(ranked(keyed, "language", [F.col("k"), F.col("word")], F.lit(True), "r"))


def frequent(ranks: DataFrame, most: int) -> dict[str, dict[str, int]]:
    """The ranks up to ``most`` of each language: a bounded number of words."""
    out: dict[str, dict[str, int]] = {}
    for r in ranks.where(F.col("r") <= most).select("language", "word", "r").collect():
        out.setdefault(r["language"], {})[r["word"]] = r["r"]
    return out


_FEATURES = T.StructType([T.StructField("language", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("coverage_rank", T.IntegerType()), T.StructField("sentence_words", T.DoubleType()), T.StructField("long_share", T.DoubleType())])


def measured(text: str | None, ranks: dict[str, dict[str, int]], most: int) -> tuple | None:
    """(language, n_words, coverage_rank, sentence_words, long_share) of a text; None if it has no prose. n_words counts all words of the text; a coverage rank beyond ``most`` is -1."""
    name, sentences = analysed(text)
    if not sentences:
        return None
    rank, rest = ranks.get(name, {}), most + 1
    lengths = [len(s) for s in sentences]
    words = [w for s in sentences for w in s]
    order = sorted([rank.get(w, rest) for w in words])
    covered = order[max(0, -int(-COVERAGE * len(order) // 1) - 1)]
    long = sum(1 for w in words if len(w) >= LONG_WORD) / len(words)
    weighted = sum(n * min(n, LONGEST_SENTENCE) for n in lengths) / len(words)
    return name, len(text.split()), covered if covered <= most else -1, weighted, long


def features(docs: DataFrame, key: str, text: str, ranks: DataFrame, most: int = RANKS) -> DataFrame:
    """(key, language, n_words, coverage_rank, sentence_words, long_share); all null for a text without prose. Cut.

    Workers have the ranks up to ``most``; documents that need a rarer word get
    their coverage rank from a join with all ranks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent(ranks, most))

    @F.arrow_udf(_FEATURES)
    def measure(a):
        import pyarrow as pa

        rows = [measured(t, sent.value, most) for t in a.to_pylist()]
        return pa.array([r and dict(zip(_FEATURES.names, r)) for r in rows], pa.struct([("language", pa.string()), ("n_words", pa.int32()), ("coverage_rank", pa.int32()), ("sentence_words", pa.float64()), ("long_share", pa.float64())]))

    found = cut(docs.select(key, measure(F.col(text)).alias("m")).select(key, "m.*"))
    far = found.where("coverage_rank = -1")
    if not far.take(1):
        return found
    exact = far_ranks(docs.join(small_side(far.select(key)), key, "left_semi"), key, text, ranks)
    d = found.join(exact, found[key].eqNullSafe(exact["__key"]), "left").withColumn("coverage_rank", F.when(F.col("coverage_rank") == -1, F.col("__rank")).otherwise(F.col("coverage_rank")))
    return cut(d.select(key, *_FEATURES.names))


def far_ranks(docs: DataFrame, key: str, text: str, ranks: DataFrame) -> DataFrame:
    """(__key, __rank): the coverage rank of each document by all ranks of its language."""
    schema = T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("language", T.StringType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("all", T.LongType())])

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, sentences = analysed(t)
                n = Counter(w for s in sentences for w in s)
                rows += [(k, name, w, c, n.total()) for w, c in n.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema.names)

    w = docs.select(key, text).dropDuplicates([key]).mapInArrow(words, schema).join(ranks.select("language", "word", "r"), ["language", "word"])
    upto = F.sum("n").over(Window.partitionBy("__key").orderBy("r"))
    return w.withColumn("upto", upto).where(F.col("upto") >= F.ceil(COVERAGE * F.col("all"))).groupBy("__key").agg(F.min("r").alias("__rank"))


_CENTRED = """
with x as (select {key} as id, language, n_words, coverage_rank, ln(coverage_rank) as a, ln(sentence_words) as b, long_share as c from {{f}} where language is not null),
m as (select language, avg(a) as ma, avg(b) as mb, avg(c) as mc from x group by language)
select id, language, n_words, coverage_rank, a - ma as x1, b - mb as x2, c - mc as x3 from x join m using (language)
"""
#: Terms of the models.
_X = ("1.0D", "x1", "x2", "x3", "x1 * x1", "x2 * x2", "x3 * x3", "x1 * x2", "x2 * x3")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> np.ndarray:
    """Coefficients of a logistic model by Newton's method; the ridge leaves the constant alone, so data that a line separates have a solution."""
    beta, prior = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge * max(1e-3, float(v)) for v in x[:, 1:].var(axis=0)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior, x.T @ (y - p) - prior @ beta)
        size = float(np.abs(step).max())
        beta = beta + step * min(1.0, 4.0 / size if size else 1.0)
        if size < 1e-8:
            break
    return beta


def calibrated(spark: SparkSession, centred: DataFrame, labels: DataFrame, key: str, label: str, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Coefficients over ``_X`` of "level is k or more" for each level above the first, from at most ``rows`` labelled documents, least hash first; empty without labels."""
    sql = f"select {', '.join(f'{t} as t{i}' for i, t in enumerate(_X))}, cast(l.{label} as double) as y from {{c}} c join {{l}} l on c.id = l.{key} where l.{label} is not null order by xxhash64(c.id), c.id, y limit {rows}"
    sample = np.array([tuple(r) for r in spark.sql(sql, c=centred, l=labels).collect()], float)
    if not len(sample):
        return {}
    x, y = sample[:, :-1], sample[:, -1]
    return {k: logistic(x, (y >= k).astype(float)) for k in LEVELS[1:]}


def level_column(models: dict[int, np.ndarray]) -> Column:
    x = [F.expr(t) for t in _X]
    p = [functools.reduce(lambda a, b: a + b, [F.lit(float(k)) * t for k, t in zip(m, x)]) for m in models.values()]
    return functools.reduce(lambda n, x: n + F.when(x >= 0, 1).otherwise(0), p, F.lit(LEVELS[0]))


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "reading_level", most: int = RANKS) -> DataFrame:
    """(key, language, n_words, coverage_rank, level): every document with prose; null, blank and prose-free texts have no level and don't come out.

    Equal texts get equal levels. Without labels the level is null.
    """
    spark = docs.sparkSession
    found = features(docs, key, text, ranking(docs, text), most)
    centred = spark.sql(_CENTRED.format(key=key), f=found)
    models = calibrated(spark, centred, labels, key, label)
    level = level_column(models) if models else F.lit(None).cast("int")
    return centred.select(F.col("id").alias(key), "language", "n_words", "coverage_rank", level.cast("int").alias("level"))
