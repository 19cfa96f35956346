"""Template residue and error-page text (problem 4).

A text field is cut into segments: its lines, and the parts of a line between
' / ', ' | ', ' · ' and ' • '. A segment is residue as a whole when it parses as
an unfilled placeholder, an editing prompt, filler, an error message with its
follow-ups, or a notice that scripts are required; each of these has its own
grammar over its own delimiters. In any other segment only unmistakable slots
(doubled or marked delimiters) count, and only their own words.

Context takes slots back: nothing in a fenced code block counts, no slot in
backticks, no slot next to a line of code or under a line that introduces an
example, no block tag of a template language and no element of a markup
language. The rest is density: a field is a case when residue makes up more than
half of its words, so a tutorial or a report about error 404 is none.

Filler is told by the corpus, not by a list: see ``filler_words``.

Everything is built-in column functions on lower-cased text; the patterns are
anchored, so a line of prose fails at its first words. No length is limited: an
open part of a message is a clause or two, however long.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.lineage import cut
from .reading import FUNCTION_WORDS

#: The words of the usual placeholder passage, and those of them by which a line is told to be of it.
PASSAGE = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi"
    " aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
TELLING = ("lorem", "ipsum", "consectetur", "adipiscing")
#: A word is filler when this share of its uses is in lines of filler; words that the passage lacks need so many of those lines. A line is filler when this share of its words is.
USED_AS_FILLER, USED_LINES, FILLER_SHARE = 0.3, 2, 0.7
#: A segment with a function word of a living language, other than those that the passage has too, is no filler.
_LIVING = r"(?<!\p{L})(?:" + "|".join(sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()} - set(PASSAGE))) + r")(?!\p{L})"

_BLOCK_TAG = r"-?\s*(?:for|if|elif|else|end\w*|set|block|include|extends|macro|raw|with|load)\b"
#: Slots with delimiters that prose doesn't use; they count wherever they stand but for backticks before them.
MARKED_SLOT = (
    r"(?<!`)(?:\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|\{%(?!" + _BLOCK_TAG + r")[^{}\n]+%\}|<%[^<>\n]+%>|\[\[[^\[\]\n]+\]\]|__[a-zà-ɏЀ-ӿऀ-ॿ][^_\n]*+(?:_[^_\n]++)*+__|##[^#\n]+##|@@[^@\n]+@@)"
)
_ELEMENT = r"/?(?:html|head|body|div|span|p|br|hr|ul|ol|li|table|thead|tbody|tr|td|th|h[1-6]|script|style|link|meta|img|form|input|button|select|option|nav|section|article|a|b|i|em|strong|code|pre|svg|iframe)(?:\s+[\w-]+=[^>]*)?\s*/?>"
#: Slots with delimiters that prose uses too; they count only as a whole segment.
LONE_SLOT = r"\[(?![\d\s,–-]+\])[^\[\]\n]+\]|\{(?!%)[^{}\n]+\}|<(?!" + _ELEMENT + r"|[!?])[^<>\n]+>|«[^«»\n]+»|%[^%\s\n][^%\n]*%"
SLOTS = f"(?:(?:{MARKED_SLOT}|{LONE_SLOT})[\\s,;|/–-]*)+"
#: Lines of code, and lines after which an example comes.
CODE_LINE = (
    r";\s*$|[^{}$%]\{\s*$|^\s*\}[\s;,)]*$|^\s*(?:import|from|def|class|return|for|if|while|else|elif|let|const|var|function|select|insert|update|public|private|print|echo)\b.*[(){}=;:]"
    r"|^\s*[\w.'\"\[\]-]+\s*[:+]?=\s*\S|</\w+>|/>\s*$|\{%" + _BLOCK_TAG + r"|^\s*<" + _ELEMENT
)
EXAMPLE_LINE = r"(?:example|syntax|snippet|template|tag|write|use|like this|placeholders?|beispiel|exemple|ejemplo|exemplo|пример|उदाहरण)[^:]*:\s*$"

#: What follows up to the end: one clause, or at most two sentences.
_OPT = r"(?!.*[.,!?;]\s+\S).*"
_THING, _REST = r"(?!.*[.,!?;]\s+\S).+", r"(?!(?:.*[.!?]\s+\S){2}).*"
_CODE = r"\(?(?:e-)?(?:0x)?[0-9a-f]{1,10}\)?"
_FAULT = (
    r"(?:(?:(?:the )?(?:requested )?(?:page|file|resource|document|url) (?:was )?)?not found|bad (?:gateway|request)|gateway time-?out|request time-?out|too many requests|internal server error|service (?:temporarily )?unavailable|method not allowed"
    rf"|access (?:to (?:this|the) (?:resource|page|document) is |is )?(?:denied|forbidden)|forbidden|unauthori[sz]ed|(?:the )?(?:request|connection) (?:has )?timed out"
    rf"|(?:could not|cannot|can.t|unable to|failed to) (?:load|reach|open|connect to|display|find|read) {_THING}|your session has (?:expired|ended|timed out){_REST}|something went wrong{_REST}"
    r"|seite (?:wurde )?nicht gefunden|zugriff verweigert|interner serverfehler|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|erreur interne du serveur|página no (?:encontrada|disponible)|acceso denegado|error interno del servidor"
    r"|página não encontrada|acesso negado|erro interno do servidor|страница не найдена|доступ запрещ[её]н|внутренняя ошибка сервера|पृष्ठ नहीं मिला|पेज नहीं मिला|पहुँच अस्वीकृत)"
)
#: Faults whose telling words stand at the end, after any start.
_GONE = rf"{_THING} (?:was|were|has been|have been) (?:moved|deleted|removed)(?: or (?:moved|deleted|removed))?"
_NO_LONGER = rf"{_THING} (?:is|are) no longer (?:here|available)"
_ERROR = "(?:error|fehler|erreur|erro|ошибка|त्रुटि)"


def _messages(fault: str) -> list[str]:
    """Error messages of a fault, with or without a code and an opening word: patterns of their own, as a long alternation of long ones is slow."""
    return [
        f"\\(?(?:http|{_ERROR})(?: status| code)?[ :#-]*{_CODE}\\)?(?: ?[:–—-]? ?{fault})?", f"(?=\\S*\\d)(?:{_CODE} ?[–—:-] ?|[45]\\d\\d ){fault}",
        f"(?:oops|sorry|{_ERROR})[!,:.]? {fault}(?: {_CODE})?", f"{fault}(?: {_CODE})?",
    ]


_NEED = (
    r"(?:(?:please |bitte |veuillez |por favor,? |пожалуйста,? )?(?:enable|turn on|activate|allow|active|activez|activer|aktivieren sie|habilite|ative|включите|разрешите) (?:java-?script|scripting|scripts|active content|cookies)\b"
    r"|java-?script (?:is|must be|has to be|seems to be) (?:switched off|turned off|turned on|off|disabled|required|needed|blocked|enabled)\b|java-?script (?:отключ[её]н|सक्षम करें)|(?:कृपया )?(?:java-?script|जावास्क्रिप्ट) (?:सक्षम|चालू) करें"
    rf"|your browser (?:does not|doesn.t) support {_REST}|(?:a script on this page|active content|(?:some )?scripts?) (?:was|were|has been|have been|is|are) (?:blocked|disabled)\b"
    r"|this (?:content|page|site|viewer|application|app) (?:needs|requires) (?:scripts?|scripting|java-?script)\b)"
)
#: Whole segments, by kind.
LINE_GRAMMARS = {
    "slot": SLOTS,
    "prompt": (
        rf"(?:double[- ])?(?:click|tap|press|touch)(?: here| on this box| this box)? to (?:add|insert|enter|edit|replace|type|write|change)\b{_THING}|select (?:here|this (?:box|field|shape)) to (?:add|insert|enter|edit|replace|type|write|change)\b{_THING}"
        rf"|(?:touchez|cliquez|appuyez|tapez)(?: ici)? pour {_THING}|(?:pulse|haga clic|toque|clique)(?: aquí| aqui)? para {_THING}|zum {_THING} (?:hier )?(?:tippen|klicken)|(?:нажмите|щ[её]лкните|коснитесь)(?: здесь)?,? чтобы {_THING}"
        rf"|(?:введите|вставьте) (?:текст|заголовок|подзаголовок|название|имя|дату|рисунок)(?: здесь)?|यहाँ (?:पाठ|शीर्षक|नाम)? ?लिखें"
        rf"|escriba (?:el|la|su|un|una) (?:título|subtítulo|texto|nombre|fecha){_OPT}|type (?:something|here|(?:your )?text){_OPT}|(?:your|insert|votre|ihr|su|seu|tu) (?:own )?(?:text|texte|texto|title|titre|título|titel|name|nom|nombre|logo|image|picture|content|subtitle|heading|caption)s? (?:here|ici|hier|aquí|aqui)"
    ),
    "filler": (
        r"(?:sample|dummy|filler|placeholder) (?:text|copy|content|title|heading|headline|caption|image|line)|(?:dummy|sample|filler|placeholder|blah|bla|foo|asdf)(?:[\s,]+(?:dummy|sample|filler|placeholder|blah|bla|bar|foo|asdf))*+"
        rf"|placeholder for {_THING}|(?:tbd|tba|tbc|todo|x{{3,}}|\?{{3,}})(?:[\s,/]+(?:tbd|tba|tbc|todo|x{{3,}}))*+|(?:…|\.\.\.)? ?to be (?:filled|completed|done|added|defined|confirmed|determined|written)(?: in| later| soon)? ?(?:…|\.\.\.)?"
        r"|(?:bullet|item|point) (?:one|two|three|four|five|[1-9])|(?:first|second|third|fourth|fifth) level|(?:erste|zweite|dritte|vierte|fünfte) ebene|(?:premier|deuxième|troisième|quatrième|cinquième) niveau|(?:primer|segundo|tercer|cuarto|quinto) nivel"
        r"|(?:первый|второй|третий|четв[её]ртый|пятый) уровень|(?:образец|пример) текста|нужно заполнить"
    ),
    "follow-up": (
        r"(?:please )?(?:reload|refresh) (?:the|this) page|(?:please )?try again later|(?:please )?go back to the (?:start|home|main) ?page|(?:zurück zur startseite|retour à l.accueil|volver al inicio|voltar ao início|вернуться на главную)|details were written to the log"
        r"|(?:bitte )?(?:versuchen sie es )?später (?:erneut|noch einmal)(?: versuchen)?|(?:veuillez )?réessayer plus tard|inténtelo (?:de nuevo )?más tarde|tente novamente mais tarde|повторите попытку позже|(?:कृपया )?बाद में (?:पुनः )?प्रयास करें"
        rf"|contact (?:the|your) administrator\b{_REST}|(?:reference|request id|incident)[: ]+[0-9a-f-]{{6,40}}"
    ),
    "script": f"{_NEED}{_REST}",
    **{f"error {i}": p for i, p in enumerate(_messages(_FAULT), 1)},
}
#: Whole segments whose telling words stand at the end or in the middle; looked for only where such a word stands.
OPEN_GRAMMARS = {
    "goes here": rf"{_THING} goes here",
    "placeholder": r"\S+(?: \S+)? placeholder",
    "durch ": rf"{_THING} durch (?:klicken|tippen) {_THING}",
    "के लिए": rf"{_THING} (?:जोड़ने|लिखने|बदलने) के लिए (?:यहाँ )?(?:क्लिक|टैप) करें",
    "no longer": "|".join(_messages(_NO_LONGER)),
    "moved": "|".join(_messages(_GONE)),
    "deleted": "|".join(_messages(_GONE)),
}
_SPACE = r"[\s\p{Z}]*"
_LEAD = r"(?:[-•▪*–·|]\s*|\d{1,2}[.)]\s+)?"
_TAIL = r"\s*[.!:…|]*" + _SPACE + "$"


def _whole(grammar: str) -> str:
    return "^" + _SPACE + _LEAD + "(?:" + grammar + ")" + _TAIL


#: Lower-cased segments that are residue as a whole, each kind a pattern of its own.
LINES = [_whole(g) for g in LINE_GRAMMARS.values()]


def _starts(items, size: int) -> set[tuple[tuple[str, ...], bool]]:
    """What a parsed pattern can begin with: runs of up to ``size`` character classes, and whether the pattern goes no further."""
    cur = {((), True)}
    for op, arg in items:
        name, step = str(op), set()
        for run, whole in cur:
            if not whole or len(run) >= size:
                step.add((run, False))
                continue
            left = size - len(run)
            if name == "LITERAL":
                nexts = {((re.escape(chr(arg)),), True)}
            elif name == "IN" and str(arg[0][0]) != "NEGATE" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
                nexts = {(("[" + "".join(re.escape(chr(v)) if str(k) == "LITERAL" else f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}" for k, v in arg) + "]",), True)}
            elif name == "BRANCH":
                nexts = set().union(*(_starts(x, left) for x in arg[1]))
            elif name == "SUBPATTERN":
                nexts = _starts(arg[3], left)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                most = min(int(high), max(int(low), left))
                nexts = set().union(*(_starts(list(inner) * n, left) for n in range(int(low) if low < left else left, most + 1)))
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                nexts = {((), True)}
            else:
                nexts = {((".",), True)}
            step |= {((run + r)[:size], w and len(run + r) <= size) for r, w in nexts}
        cur = step
    return cur


def _gate(grammars, size: int = 3) -> str:
    """A pattern that every segment of the grammars matches, made of the ways in which they begin."""
    tree: dict = {}
    for g in grammars:
        for run, _ in _starts(re._parser.parse(g), size):
            node = tree
            for c in run:
                if node is None:
                    break
                node = node.setdefault(c, {})
            else:
                node[""] = {}

    def text(node: dict) -> str:
        if "" in node or not node:
            return ""
        parts = [c + text(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return "^" + _SPACE + _LEAD + text(tree)


#: What any segment of LINES begins with: one cheap pattern that most lines of prose fail.
GATE = _gate(LINE_GRAMMARS.values())
SLOT_LINE = _whole(SLOTS)
_MARKED = r"\{\{|\$\{|\{%|<%|\[\[|__|##|@@"
_SEPARATOR = r"\n|\s[/|·•]\s"
_WORD = r"[\p{L}\p{N}][^\s\p{Z}]*"
_FENCE = "```|~~~"
#: Characters that make a slot or part a line; code in fences is read without them.
_DELIMITERS = "{}[]<>«»%$#@_/|·•"


def word_count(line: Column) -> Column:
    """Runs of characters other than white space that begin with a letter or digit."""
    return F.regexp_count(line, F.lit(_WORD))


def segments(field: Column) -> Column:
    """The lower-cased segments of an array of text blocks; code in fences is made unlike any residue."""
    text = F.lower(F.array_join(field, "\n"))
    mask = lambda p, i: F.when(i % 2 == 1, F.regexp_replace(F.translate(p, _DELIMITERS, " " * len(_DELIMITERS)), "(?m)^", "\x02")).otherwise(p)
    open_text = F.when(text.rlike(_FENCE), F.array_join(F.transform(F.split(text, _FENCE), mask), "\n")).otherwise(text)
    return F.split(open_text, _SEPARATOR)


def residue_words(line: Column, before: Column, after: Column) -> Column:
    """How many of a segment's words are residue, by the grammars and the segments around it; both may be null."""
    whole = F.lit(False)
    for pattern in LINES:
        whole = whole | line.rlike(pattern)
    opened = F.lit(False)
    for word, grammar in OPEN_GRAMMARS.items():
        opened = opened | (F.contains(line, F.lit(word)) & line.rlike(_whole(grammar)))
    code = lambda x: F.coalesce(x.rlike(CODE_LINE), F.lit(False))
    shown = code(before) | code(after) | F.coalesce(before.rlike(EXAMPLE_LINE), F.lit(False))
    slots = F.aggregate(F.regexp_extract_all(line, F.lit(f"({MARKED_SLOT})"), F.lit(0)), F.lit(0), lambda a, s: a + word_count(s))
    slotted = line.rlike(_MARKED)
    whole = line.rlike(GATE) & whole | opened
    return (
        F.when(whole, F.when(line.rlike(SLOT_LINE) & shown, 0).otherwise(word_count(line)))
        .when(slotted, F.when(shown | code(line), 0).otherwise(slots)).otherwise(F.lit(0))
    )


def field_counts(field: Column) -> Column:
    """STRUCT<words, residue, open> of an array of text blocks: its words, those that the grammars tell as residue, and the other segments of several words that no living language is told by; null and empty fields have 0, 0 and none."""
    item = lambda x, s, i: F.struct(word_count(x).alias("words"), residue_words(x, F.get(s, i - 1), F.get(s, i + 1)).alias("residue"), x.alias("line"))
    add = lambda o, f: F.aggregate(o, F.lit(0), lambda a, x: a + x[f])

    def summed(o):
        strange = F.filter(o, lambda x: (x["residue"] == 0) & (x["words"] > 1) & ~x["line"].rlike(_LIVING))
        return F.struct(add(o, "words").alias("words"), add(o, "residue").alias("residue"), F.transform(strange, lambda x: x["line"]).alias("open"))

    # bound to lambdas' variables, so that segments and counts are made once
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("residue"), F.array().cast("array<string>").alias("open"))
    return F.coalesce(bound(segments(field), lambda s: bound(F.transform(s, lambda x, i: item(x, s, i)), summed)), none)


def filler_segments(rows: DataFrame) -> DataFrame:
    """(slide_key, field_name, extra): the words of a field's filler segments. rows: slide_key, field_name, open; cut.

    Filler is a property of the corpus. Segments with a telling word of the usual
    placeholder passage give the candidates: their words. All uses of a candidate
    in the corpus's open segments are counted; it is kept if enough of them are in
    segments with a telling word (a word of ordinary texts has few there). A
    second round takes all segments that consist of kept words for the context,
    which finds those without any telling word, and gives up words whose segments
    are of other words mostly.
    """
    letters = lambda c: F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))
    parts = rows.where(F.size("open") > 0).select("slide_key", "field_name", F.posexplode("open").alias("n", "line"))
    told = parts.where(F.col("line").rlike(r"\b(?:" + "|".join(TELLING) + r")\b"))
    first = told.select(F.explode(letters(F.col("line"))).alias("word"), F.xxhash64("line").alias("l")).groupBy("word").agg(F.count("*").alias("n_in"), F.count_distinct("l").alias("n_lines"))
    first = cut(first.where((F.col("n_lines") >= USED_LINES) | F.col("word").isin(PASSAGE)))
    uses = parts.select(F.explode(letters(F.col("line"))).alias("word")).join(small_side(first), "word").groupBy("word").agg(F.count("*").alias("n_all"), F.max("n_in").alias("n_in"))
    kept = cut(uses.where(F.col("n_in") >= USED_AS_FILLER * F.col("n_all")))
    words = parts.select("slide_key", "field_name", "n", "line", F.posexplode(letters(F.col("line"))).alias("i", "word"))
    hits = cut(words.join(small_side(kept.select("word", "n_all")), "word").distinct())
    at = ["slide_key", "field_name", "n", "line"]
    filler = lambda w: w.groupBy(*at).agg(F.count("*").alias("hits")).where((F.col("hits") >= 2) & (F.col("hits") >= FILLER_SHARE * word_count(F.col("line"))))
    again = hits.join(filler(hits).select(*at), at, "left_semi").groupBy("word").agg((F.count("*") >= USED_AS_FILLER * F.max("n_all")).alias("ok")).where("ok").select("word")
    found = filler(hits.join(small_side(again), "word", "left_semi"))
    return found.groupBy("slide_key", "field_name").agg(F.sum(word_count(F.col("line"))).cast("int").alias("extra"))


def counted_fields(slides: DataFrame) -> DataFrame:
    """(slide_key, field_name, words, residue, open) of every field with words, a redelivered row's too. Cut: it is made in the one pass over the text."""
    # counted below the explode, so that no filter or projection counts again
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), field_counts(F.col(f)).alias("n")) for f in ("text", "notes")])
    return cut(slides.select("slide_key", F.explode(each).alias("f")).select("slide_key", "f.field_name", "f.n.*").where("words > 0"))


def residue_density(slides: DataFrame) -> DataFrame:
    """(slide_key, field_name, words, residue_words): each slide and field that has words, once."""
    rows = counted_fields(slides)
    extra = small_side(cut(filler_segments(rows)))
    d = rows.select("slide_key", "field_name", "words", "residue").distinct().join(extra, ["slide_key", "field_name"], "left")
    return d.select("slide_key", "field_name", "words", (F.col("residue") + F.coalesce("extra", F.lit(0))).alias("residue_words"))


def residue_fields(slides: DataFrame) -> DataFrame:
    """(slide_key, field_name) of the fields of which more than half of the words are residue, each once.

    A field with exactly half isn't a case; null and empty fields never are; a
    redelivered row counts once.
    """
    return residue_density(slides).where(F.col("residue_words") * 2 > F.col("words")).select("slide_key", "field_name")
