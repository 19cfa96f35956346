"""Text structure of slides and decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

#: What makes a block a paragraph or a pointer, and weights of the structure score.
PARAGRAPH_WORDS, PARAGRAPH_CHARS, PARAGRAPH_SENTENCES, POINTER_WORDS, HEAVY, EASY = 45, 240, 3, 18, 0.55, 0.35
#: Broad claims, and what makes a sentence specific.
BROAD = (
    "advanced", "better", "comprehensive", "cost effective", "cost-effective", "efficient", "fast", "improved", "intelligent", "optimized", "quick", "real time", "real-time", "robust", "scalable", "secure", "seamless",
)
SPECIFIC = (
    r"(?iU)\d|%|\b(?:accuracy|baseline|benchmark|demo|github|latency|measure|metric|ms|percent|reference|source|target|test|throughput|validated|users?|devices?|requests?)\b|\b(?:using|via|through|with)\s+[A-Za-z0-9]"
)
#: Phrases of filler.
FILLER = (
    "innovative solution", "cutting edge", "cutting-edge", "game changer", "game-changing", "revolutionary", "seamless experience", "unlock the potential", "leverage the power", "transform the way", "next generation",
    "user friendly", "user-friendly", "end to end", "end-to-end", "powered by ai",
)
#: Phases of a deck in their order, and the kinds of slides, with the terms that tell them; the first that has a term counts.
PHASES = {
    "problem": ["problem", "challenge", "pain point", "need", "objective", "requirement"], "solution": ["solution", "approach", "proposed", "how it works", "workflow", "process"],
    "build": ["architecture", "system design", "implementation", "technology", "tech stack", "model"], "evidence": ["prototype", "demo", "result", "evaluation", "validation", "testing", "benchmark", "metric"],
    "close": ["conclusion", "summary", "next step", "roadmap", "future work", "thank you"],
}
SLIDE_TYPES = {
    "architecture": ["architecture", "system design", "component"], "process": ["workflow", "process", "pipeline", "steps"], "results": ["result", "output", "evaluation", "performance"], "comparison": ["comparison", "versus", " vs "],
}


def once(slides: DataFrame) -> DataFrame:
    """Each slide once, however often it was delivered; redelivered rows are equal but for their time."""
    return slides.dropDuplicates(["slide_key"])


BLOCK = ["slide_key", "block_no"]


def blocks(slides: DataFrame) -> DataFrame:
    """(slide_key, deck_id, slide_number, block_no, text): the squeezed, non-blank text blocks of every delivery of a slide.

    Operators below reduce a block to what they need of it before they take each
    block once, so that redelivered rows are told from what is narrow and text
    isn't shuffled.
    """
    d = slides.select("slide_key", "deck_id", "slide_number", F.posexplode("text").alias("block_no", "text"))
    return d.withColumn("text", tx.squeeze(F.col("text"))).where("text <> ''")


def deck_texts(slides: DataFrame) -> DataFrame:
    """(deck_id, text): all blocks of a deck in the order of its slides, one a line; a slide delivered again counts once."""
    s = F.struct("slide_number", "slide_key", F.array_join("text", "\n").alias("text"))
    d = slides.groupBy("deck_id").agg(F.array_sort(F.collect_set(s)).alias("s"))
    return d.select("deck_id", F.array_join("s.text", "\n").alias("text"))


def is_label(c: Column) -> Column:
    """Whether a label, that is, words before a colon, stands anywhere."""
    return F.contains(c, F.lit(":")) & c.rlike(r"(?U)\b[A-Za-z][A-Za-z0-9 /&+()'-]{1,30}:")


def is_bullet(c: Column) -> Column:
    return c.rlike(r"[•▪◦●◉‣*-]\s") & c.rlike(r"(?U)(?:^|\s)[•▪◦●◉‣*-]\s")


def paragraph_like(words: Column, chars: Column, sentences: Column) -> Column:
    return (words >= PARAGRAPH_WORDS) | (chars >= PARAGRAPH_CHARS) | (sentences >= PARAGRAPH_SENTENCES)


def profile(t: Column) -> Column:
    """STRUCT<chars, words, sentences, is_label, is_bullet, paragraph_like, pointer_like> of a squeezed text."""
    clean = tx.without_links(t)
    one = lambda c: F.struct(F.length(t).alias("chars"), tx.word_count(t).alias("words"), tx.sentence_count(c).alias("sentences"), is_label(c).alias("is_label"), is_bullet(t).alias("is_bullet"))

    def flags(x):
        long = paragraph_like(x["words"], x["chars"], x["sentences"])
        return F.struct(*[x[k].alias(k) for k in ("chars", "words", "sentences", "is_label", "is_bullet")], long.alias("paragraph_like"), (~long & ((x["words"] <= POINTER_WORDS) | x["is_label"] | x["is_bullet"])).alias("pointer_like"))

    return F.get(F.transform(F.transform(F.array(clean), one), flags), F.lit(0))


def _holds(term: str):
    return lambda s: tx.has_phrase(s, [term])


def broad_terms(t: Column, terms=BROAD) -> Column:
    """ARRAY<STRING>: the terms of a text that stand in a sentence of four words or more that nothing makes specific, in order."""
    sentences = F.split(tx.without_links(t), r"(?U)(?<=[.!?])\s+")
    vague = F.filter(sentences, lambda s: tx.has_phrase(s, terms) & (tx.word_count(s) >= 4) & ~s.rlike(SPECIFIC))
    found = F.array(*[F.when(F.exists(vague, _holds(k)), F.lit(k)) for k in sorted(terms)])
    # most texts have no term at all
    return F.when(tx.has_phrase(t, terms), F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def text_profile(b: DataFrame) -> DataFrame:
    """Blocks with chars, words, sentences, is_label, is_bullet, paragraph_like, pointer_like."""
    d = b.select("slide_key", "deck_id", "slide_number", "block_no", F.explode(F.array(profile(F.col("text")))).alias("p"))
    return d.select("slide_key", "deck_id", "slide_number", "block_no", "p.*").dropDuplicates(BLOCK)


def body_blocks(text: Column) -> Column:
    """The squeezed, non-blank blocks of a slide but for the first, its title; a null text has none."""
    all_ = F.filter(F.transform(F.coalesce(text, F.array().cast("array<string>")), lambda t: tx.squeeze(t)), lambda t: t != "")
    return F.slice(all_, 2, 2**30)


def structure(body: Column, has_visual: Column) -> Column:
    """STRUCT of a slide's body: chars, paragraph_chars, pointer_chars, n_blocks, n_broad, n_filler and its structure score.

    A slide without body scores 0.7 if it shows something else and 0 otherwise.
    """
    item = lambda t: F.struct(profile(t).alias("p"), F.when(F.size(broad_terms(t)) > 0, 1).otherwise(0).alias("broad"), F.when(tx.has_phrase(t, FILLER), 1).otherwise(0).alias("filler"))

    def summed(o):
        add = lambda f: F.aggregate(o, F.lit(0), lambda a, x: a + f(x))
        return F.struct(
            add(lambda x: x["p"]["chars"]).alias("chars"), add(lambda x: F.when(x["p"]["paragraph_like"], x["p"]["chars"]).otherwise(0)).alias("paragraph_chars"),
            add(lambda x: F.when(x["p"]["pointer_like"], x["p"]["chars"]).otherwise(0)).alias("pointer_chars"), F.size(o).alias("n_blocks"), add(lambda x: x["broad"]).alias("n_broad"), add(lambda x: x["filler"]).alias("n_filler"),
        )

    def scored(x):
        ratio = x["paragraph_chars"] / x["chars"]
        base = F.when(ratio <= EASY, 1.0).otherwise(F.greatest(F.lit(0.0), (1 - ratio) / (1 - EASY)))
        score = F.when(x["chars"] > 0, F.greatest(F.lit(0.0), base - F.least(F.lit(0.25), x["n_broad"] * 0.05))).otherwise(F.when(has_visual, 0.7).otherwise(0.0))
        return F.struct(*[x[k].alias(k) for k in ("chars", "paragraph_chars", "pointer_chars", "n_blocks", "n_broad", "n_filler")], score.alias("score"))

    return F.get(F.transform(F.transform(F.array(F.transform(body, item)), summed), scored), F.lit(0))


def structured(slides: DataFrame) -> DataFrame:
    """(slide_key, deck_id, chars, paragraph_chars, pointer_chars, n_blocks, n_broad, n_filler, score): each slide once; text isn't shuffled."""
    d = slides.select("slide_key", "deck_id", F.explode(F.array(structure(body_blocks(F.col("text")), F.lit(False)))).alias("s"))
    return d.select("slide_key", "deck_id", "s.*").dropDuplicates(["slide_key"])


def structure_aggregates() -> list[Column]:
    """Aggregates of ``structure`` columns over a deck: shares of paragraph and pointer characters, of heavy slides among those with body and of blocks with broad claims, and the mean score."""
    heavy = F.when(F.col("chars") > 0, (F.col("paragraph_chars") / F.col("chars") >= HEAVY).cast("int"))
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return [
        F.round(share("paragraph_chars", "chars"), 6).alias("paragraph_ratio"), F.round(share("pointer_chars", "chars"), 6).alias("pointer_ratio"), F.round(F.coalesce(F.avg(heavy), F.lit(0.0)), 6).alias("heavy_ratio"),
        F.round(share("n_broad", "n_blocks"), 6).alias("ambiguous_ratio"), F.round(F.avg("score"), 6).alias("structure_score"),
    ]


def content_structure(slides: DataFrame) -> DataFrame:
    """(deck_id, paragraph_ratio, pointer_ratio, heavy_ratio, ambiguous_ratio, structure_score) of every deck with slides."""
    return structured(slides).groupBy("deck_id").agg(*structure_aggregates())


def filler_ratio(slides: DataFrame) -> DataFrame:
    """(deck_id, n_blocks, filler_ratio): share of body blocks with a phrase of filler; null for a deck without body."""
    g = structured(slides).groupBy("deck_id").agg(F.sum("n_blocks").alias("n_blocks"), F.sum("n_filler").alias("n"))
    return g.select("deck_id", "n_blocks", F.round(F.try_divide(F.col("n"), F.col("n_blocks")), 6).alias("filler_ratio"))


def term_counts(b: DataFrame, terms) -> DataFrame:
    """(term, n_blocks, n_decks) of the blocks that hold each term."""
    d = b.select(*BLOCK, "deck_id", F.explode(F.array_compact(F.array(*[F.when(tx.has_phrase(F.col("text"), [t]), F.lit(t)) for t in terms]))).alias("term")).distinct()
    return d.groupBy("term").agg(F.count("*").alias("n_blocks"), F.count_distinct("deck_id").alias("n_decks"))


def ambiguous_claims(b: DataFrame, terms=BROAD) -> DataFrame:
    """(slide_key, block_no, terms): the blocks with broad claims, and their terms."""
    return b.select("slide_key", "block_no", F.array_join(broad_terms(F.col("text"), terms), ",").alias("terms")).where("terms <> ''").dropDuplicates(BLOCK)


def first_match(text: Column, kinds: dict[str, list[str]]) -> Column:
    """The first kind of which a term is part of the text, else null."""
    out = None
    for name, terms in kinds.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(text, F.lit(t))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def slide_kinds(slides: DataFrame) -> DataFrame:
    """(slide_key, deck_id, slide_number, phase, slide_type, blank): each slide once, told by all of its text; the phase is null where no term stands, the type then is content."""
    t = F.lower(tx.squeeze(F.coalesce(F.array_join("text", " "), F.lit(""))))
    kinds = F.struct(first_match(F.col("t"), PHASES).alias("phase"), F.coalesce(first_match(F.col("t"), SLIDE_TYPES), F.lit("content")).alias("slide_type"), (F.col("t") == "").alias("blank"))
    return slides.select("slide_key", "deck_id", "slide_number", t.alias("t")).select("slide_key", "deck_id", "slide_number", kinds.alias("k")).select("slide_key", "deck_id", "slide_number", "k.*").dropDuplicates(["slide_key"])


def flow_aggregates() -> list[Column]:
    """Aggregates over a deck's slides (slide_number, phase, slide_type, blank): where each phase comes first, the edges of the deck, and the share of slides that show a flow."""
    edge = F.struct("slide_number", "phase", "blank")
    return [
        *[F.min(F.when(F.col("phase") == n, F.col("slide_number"))).alias(f"at_{n}") for n in PHASES], F.min(edge).alias("first"), F.max(edge).alias("last"), F.count("*").alias("n_slides"),
        F.avg(F.col("slide_type").isin("process", "architecture").cast("int")).alias("flow_signal"),
    ]


def flow_scores(g: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coverage, ordered, opening, closing, flow) from ``flow_aggregates``.

    A deck's first slide without a phase counts as the first phase and its last
    one as the last, if they have text and the deck has other slides.
    """
    names = list(PHASES)
    own = lambda side, name: F.when((F.col("n_slides") > 1) & F.col(f"{side}.phase").isNull() & ~F.col(f"{side}.blank"), F.col(f"{side}.slide_number")).alias(name)
    at = [F.col(f"at_{n}") for n in names]
    at[0], at[-1] = F.least(at[0], own("first", "f")), F.least(at[-1], own("last", "l"))
    d = g.withColumn("p", F.array_compact(F.array(*at))).withColumns({"n": F.size("p"), "opening": at[0].isNotNull().cast("int"), "closing": at[-1].isNotNull().cast("int")})
    steps = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: (i < F.col("n")) & (F.try_element_at("p", i) <= F.try_element_at("p", i + 1))))
    coverage, order = F.col("n") / len(names), steps / F.greatest(F.col("n") - 1, F.lit(1))
    flow = 0.4 * coverage + 0.3 * order + 0.2 * F.col("opening") + 0.1 * F.greatest("closing", "flow_signal")
    return d.select(*keys, F.round(coverage, 6).alias("coverage"), F.round(order, 6).alias("ordered"), "opening", "closing", F.round(flow, 6).alias("flow"))


def narrative_flow(slides: DataFrame) -> DataFrame:
    """(deck_id, coverage, ordered, opening, closing, flow): which phases a deck has, whether they come in order, and whether it opens and closes."""
    return flow_scores(slide_kinds(slides).groupBy("deck_id").agg(*flow_aggregates()), ["deck_id"])


def duplicate_content(slides: DataFrame) -> DataFrame:
    """(deck_id, n_slides, n_repeats, duplicate_ratio) over a deck's slides with text; a text's slides after the first are repeats."""
    t = tx.fold(F.array_join("text", " "))
    d = slides.select("slide_key", "deck_id", t.alias("t")).where("t <> ''").select("slide_key", "deck_id", F.xxhash64("t").alias("t1"), F.xxhash64(F.lit("t"), "t").alias("t2")).dropDuplicates(["slide_key"])
    g = d.groupBy("deck_id", "t1", "t2").agg(F.count("*").alias("n")).groupBy("deck_id").agg(F.sum("n").alias("n_slides"), F.sum(F.col("n") - 1).alias("n_repeats"))
    return g.withColumn("duplicate_ratio", F.round(F.col("n_repeats") / F.col("n_slides"), 6))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, weighted_median): the first value at which the running weight reaches half of the total."""
    g = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    run, total = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    d = g.withColumns({"__run": F.sum("__w").over(run), "__all": F.sum("__w").over(total)}).where(F.col("__run") * 2 >= F.col("__all"))
    return d.groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def visible_share(statuses: Column, visible: Column) -> Column:
    """Share of the stages asked for whose evidence is seen, wholly or in part; where none was asked for, 1 if the slide shows anything."""
    asked = F.filter(statuses, lambda s: s.isNotNull() & ~s.isin("not_requested", "not_applicable"))
    return F.coalesce(F.try_divide(F.size(F.filter(asked, lambda s: s.isin("verified", "partial"))), F.size(asked)), F.when(visible, 1.0).otherwise(0.0))


def evidence_visibility(slides: DataFrame, stages: list[str]) -> DataFrame:
    """(deck_id, visibility, n_slides): mean over a deck's slides of ``visible_share``, rounded slide by slide."""
    visible = F.coalesce(F.exists("text", lambda t: tx.squeeze(t) != ""), F.lit(False))
    d = slides.select("slide_key", "deck_id", F.round(visible_share(F.array(*[F.col(f"visibility.{s}") for s in stages]), visible), 6).alias("v")).dropDuplicates(["slide_key"])
    return d.groupBy("deck_id").agg(F.round(F.avg("v"), 6).alias("visibility"), F.count("*").alias("n_slides"))


def links(slides: DataFrame) -> DataFrame:
    """(deck_id, target, n_slides, first_slide, slides): each external target of a deck once, with the slides that hold it in order."""
    d = once(slides).select("deck_id", "slide_number", F.explode("hyperlinks").alias("l")).select("deck_id", "slide_number", tx.external_target(F.col("l")).alias("target")).where("target is not null")
    g = d.groupBy("deck_id", "target").agg(F.array_sort(F.collect_set("slide_number")).alias("s"))
    return g.select("deck_id", "target", F.size("s").alias("n_slides"), F.element_at("s", 1).alias("first_slide"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("slides"))
