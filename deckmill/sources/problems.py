"""Problem statements from JSON files and from HTML pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import problem_id, squeeze

REQUIREMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("description", T.StringType()), T.StructField("weight", T.DoubleType())])
PROBLEM = T.StructType([T.StructField("id", T.StringType(), True), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("requirements", T.ArrayType(REQUIREMENT))])
#: Shortest bullet and sentence that make a requirement, and the most of a statement.
BULLET, SENTENCE, MOST = 12, 24, 12


def read_problems(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The valid statements (ps_id, title, description, requirements) of JSON files, and (path, reason) of the others."""
    d = spark.read.schema(PROBLEM).option("multiLine", "true").json(paths).withColumn("path", F.input_file_name())
    ids, weights = F.transform("requirements", lambda r: r["id"]), F.transform("requirements", lambda r: r["weight"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.concat_ws(
        ",", F.when(blank("id"), "id"), F.when(blank("title"), "title"), F.when(blank("description"), "description"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated requirement"),
        F.when(F.exists(weights, lambda w: w < 0), "negative weight"),
    )
    d = d.withColumn("reason", reason)
    return d.where("reason = ''").select(problem_id(F.col("id")).alias("ps_id"), "title", "description", "requirements"), d.where("reason <> ''").select("path", "reason")


class _Page(HTMLParser):
    """Fields of the statements on a page: header cells name the data cells beside them."""

    def __init__(self, marker: str):
        super().__init__(convert_charrefs=True)
        self.marker, self.found, self.key, self.cell, self.buffer, self.depth = marker, {}, None, None, [], 0
        self.name = ""

    def handle_starttag(self, tag, attrs):
        ident = dict(attrs).get("id") or ""
        if tag == "div":
            if self.key is not None:
                self.depth += 1
            elif ident.startswith(self.marker):
                self.key, self.depth = ident[len(self.marker) :], 1
                self.fresh = self.key not in self.found
                if self.fresh:
                    self.found[self.key] = {}
        elif self.key is not None and tag in ("th", "td"):
            self.close_cell()
            self.cell, self.buffer = tag, []
        elif self.cell and tag in ("br", "p", "li"):
            self.buffer.append("\n• " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        if self.key is None:
            return
        if tag in ("th", "td"):
            self.close_cell()
        elif tag == "div":
            self.depth -= 1
            if not self.depth:
                self.close_cell()
                self.key = None

    def handle_data(self, data):
        if self.cell:
            self.buffer.append(data)

    def close_cell(self):
        if self.cell:
            text = "\n".join(" ".join(x.split()) for x in "".join(self.buffer).split("\n")).strip()
            if self.cell == "th":
                self.name = text.lower()
            elif self.fresh and self.name:
                self.found[self.key].setdefault(self.name, re.sub(r"\n{2,}", "\n", text))
        self.cell = None


#: What opens the part with requirements and the clause on performance, and the sentence that stands for a statement without any.
EXPECTED, BENCHMARK = r"(?i)\bexpected\s+solution\b", r"(?i)\bperformance\s+benchmark\b"
BENCHMARK_FORM, FALLBACK = "Performance Benchmark: %s", "Address the official problem statement: %s."


def requirements_of(title: Column, description: Column) -> Column:
    """ARRAY<REQUIREMENT> of a statement's text, each of weight 1.

    Of what follows "expected solution": the bullets, without any the sentences,
    without any one that names the title; last the clause on performance. Short
    pieces don't count, each text counts once whatever its case, and at most MOST
    are taken.
    """
    body = F.element_at(F.split(F.coalesce(description, F.lit("")), EXPECTED, 2), -1)
    halves = F.split(body, BENCHMARK, 2)
    text = F.get(halves, F.lit(0))
    clause = F.regexp_replace(squeeze(F.get(halves, F.lit(1))), "^[: ]+", "")
    long = lambda parts, least: F.filter(parts, lambda x: F.length(x) >= least)
    pieces = F.transform(F.split(text, "•"), lambda x: F.regexp_replace(squeeze(x), "^[-* ]+", ""))
    bullets = long(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), BULLET)
    sentences = long(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: squeeze(x)), SENTENCE)
    found = F.when(F.size(bullets) > 0, bullets).when(F.size(sentences) > 0, sentences).otherwise(F.array(F.format_string(FALLBACK, title)))
    found = F.concat(found, F.when(clause != "", F.array(F.format_string(BENCHMARK_FORM, clause))).otherwise(F.array().cast("array<string>")))
    once = F.aggregate(found, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(F.slice(once, 1, MOST), lambda x, i: F.struct(F.concat(F.lit("r"), (i + 1).cast("string")).alias("id"), x.alias("description"), F.lit(1.0).alias("weight")))


def page_problems(html: str | None, marker: str) -> list[dict]:
    """(id, title, description) of a page's statements; of an id that comes again the first counts."""
    p = _Page(marker)
    p.feed(html or "")
    p.close()
    field = lambda f, word: next((v for k, v in f.items() if word in k), None)
    return [{"id": key, "title": field(f, "title"), "description": field(f, "description") or ""} for key, f in p.found.items()]


def parse_pages(pages: DataFrame, html: str, marker: str = "ViewProblemStatement") -> DataFrame:
    """(id, title, description, requirements) of the statements of a column of HTML pages."""
    plain = T.StructType(PROBLEM.fields[:3])

    @F.arrow_udf(T.ArrayType(plain))
    def parse(a):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([page_problems(x, marker) for x in a.to_pylist()], to_arrow_type(T.ArrayType(plain)))

    return pages.select(F.explode(parse(F.col(html))).alias("p")).select("p.*").withColumn("requirements", requirements_of(F.col("title"), F.col("description")))
