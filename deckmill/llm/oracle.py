"""SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

import unicodedata

_TOP = """
with latest as (
  select distinct ps_id, submission_id, final_score, proposal_score, deck_quality_score, status from (
    select *, max(scored_at) over (partition by ps_id, submission_id) as last_at from submissions) where scored_at = last_at),
ranked as (
  select ps_id, submission_id, row_number() over (partition by ps_id order by final_score desc,
    case when proposal_score is null or isnan(proposal_score) then 0 else proposal_score end desc,
    case when deck_quality_score is null or isnan(deck_quality_score) then 0 else deck_quality_score end desc, lower(submission_id), submission_id) as rank_in_group
  from latest where final_score is not null and not isnan(final_score) and coalesce(status, '') <> 'failed')
select {cols} from ranked where rank_in_group <= 5
"""

_LINES = """
with members as (select distinct ps_id, deck_id from submissions where ps_id is not null and deck_id is not null),
totals as (select ps_id, count(*) as total from members group by ps_id),
pieces as (select deck_id, unnest(string_split(array_to_string(list_filter(text, lambda x: x is not null), chr(10)), chr(10))) as piece from slides where text is not null),
forms as (select distinct deck_id, regexp_replace(trim(regexp_replace(lower(piece), '[\\s\\p{Z}]+', ' ', 'g')), '[0-9]+', '#', 'g') as line from pieces),
counts as (select ps_id, line, count(*) as n from members join forms using (deck_id) where line <> '' group by ps_id, line)
select ps_id, line from counts join totals using (ps_id) where n >= 5 and n >= 0.25 * total
"""


_FORM = "regexp_replace(trim(regexp_replace(lower({}), '[\\s\\p{{Z}}]+', ' ', 'g')), '[0-9]+', '#', 'g')"
_CLEAN = (
    _LINES.replace("select ps_id, line from counts join totals", "select distinct deck_id, line from (select ps_id, line from counts join totals", 1)
    + ") q join members using (ps_id)"
)
_CLEAN = f"""
with out_lines as ({_CLEAN}), s as (select distinct on (slide_key) slide_key, deck_id, text from slides),
b as (select slide_key, deck_id, unnest(text) as block, generate_subscripts(text, 1) as i from s),
p as (select slide_key, deck_id, i, unnest(string_split(block, chr(10))) as piece, generate_subscripts(string_split(block, chr(10)), 1) as j from b where block is not null),
k as (select p.slide_key, i, string_agg(piece, chr(10) order by j) as block from p where not exists (select 1 from out_lines o where o.deck_id = p.deck_id and o.line = {_FORM.format("p.piece")}) group by p.slide_key, i),
g as (select slide_key, list(block order by i) as text from k where block <> '' group by slide_key)
select s.slide_key, case when s.text is null or s.deck_id is null or s.deck_id not in (select deck_id from out_lines) then s.text else coalesce(g.text, []) end as text from s left join g using (slide_key)
"""

_SETS = """
with s as (select distinct on (slide_key) slide_key, regexp_extract_all(lower(array_to_string(list_filter(text, lambda x: x is not null), ' ')), '[\\p{L}\\p{N}]+') as w from slides where text is not null),
grams as (select distinct 'slide' as record_type, slide_key as key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as e from s where len(w) >= 40),
files as (select distinct 'deck' as record_type, deck_id as key, lower(sha256) as e from assets where sha256 is not null),
elements as (select * from grams union all select * from files where key in (select key from files group by key having count(*) >= 5)),
sizes as (select record_type, key, count(*) as n from elements group by record_type, key),
common as (select a.record_type, a.key as key_a, b.key as key_b, count(*) as c from elements a join elements b on a.record_type = b.record_type and a.e = b.e and a.key < b.key group by 1, 2, 3)
select c.record_type, key_a, key_b from common c join sizes a on a.record_type = c.record_type and a.key = key_a join sizes b on b.record_type = c.record_type and b.key = key_b
where c.c >= (case c.record_type when 'slide' then 0.7 else 0.6 end) * (a.n + b.n - c.c)
"""


_CLASSES = (
    _SETS.replace(")\nselect c.record_type, key_a, key_b from common", "),\npairs as (select c.record_type, key_a, key_b from common", 1)
    + """),
marks as (select record_type, key, md5(string_agg(e, '|' order by e)) as g from elements group by record_type, key),
cls as (select record_type, key, min(key) over (partition by record_type, g) as class_id from marks),
reps as (select record_type, key from cls where key = class_id),
ends as (select p.record_type, unnest([key_a, key_b]) as key from pairs p join reps a on a.record_type = p.record_type and a.key = key_a join reps b on b.record_type = p.record_type and b.key = key_b),
n as (select record_type, key, count(*) as n_links from ends group by record_type, key)
select c.record_type, c.key, class_id, coalesce(n_links, 0) as n_links from cls c left join n on n.record_type = c.record_type and n.key = class_id
"""
)

#: Residue by phrases, delimiters and shares of words: plain string functions, none of the operator's patterns.
_RESIDUE = """
with s as (select distinct on (slide_key) slide_key, text, notes from slides),
f as (select slide_key, 'text' as field_name, text as x from s union all select slide_key, 'notes', notes from s),
l as (select slide_key, field_name, unnest(string_split(replace(array_to_string(list_filter(x, lambda e: e is not null), chr(10)), ' / ', chr(10)), chr(10))) as line from f where x is not null),
p as (select row_number() over () as id, slide_key, field_name, trim(lower(line)) as line, list_filter(string_split_regex(trim(lower(line)), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')) as w from l),
u as (select id, unnest(list_transform(w, lambda x: trim(x, '.,;:!?…()'))) as word from p),
n as (select word, count(*) as n, count(*) filter (line like '%lorem%' or line like '%ipsum%') as k, count(distinct line) filter (line like '%lorem%' or line like '%ipsum%') as d from u join p using (id) group by word),
filler as (select word from n where d >= 2 and k >= 0.3 * n),
h as (select id, count(*) as hits from u join filler using (word) group by id),
r as (select slide_key, field_name, len(w) as n, coalesce(hits, 0) >= greatest(2, 0.7 * len(w))
  or len(line) > 2 and (left(line, 1) || right(line, 1) in ('[]', '{}', '<>', '«»', '%%') or starts_with(line, '${') or starts_with(line, '__') and ends_with(line, '__'))
  or list_bool_or(list_transform(['click to ', 'tap to ', 'double-tap to ', 'press here to ', 'select this box to ', 'touchez ici pour ', 'pulse aquí para ', 'escriba el ', 'zum eintragen ', 'type something', 'votre texte ici', 'your text here', 'sample text',
     'placeholder for ', 'bullet ', 'xxxx', 'tbd', 'to be filled', '…to be', 'second level', 'third level', 'fourth level', 'zweite ebene', 'dritte ebene',
     'error 4', 'error 5', 'error 0x', 'error e-', '0x', 'http 4', 'http 5', 'http 0x', 'http e-', '(error ', 'oops!', 'reload the page', 'try again later', 'go back to the start', 'bitte später', 'retour à l', 'details were written', 'contact the administrator', 'reference: ',
     'javascript is ', 'turn on scripting', 'allow active content', 'enable ', 'dummy', 'blah', 'foo bar', 'asdf', 'xxx', '… to be', 'please enable javascript', 'active javascript', 'bitte aktivieren sie javascript', 'veuillez activer javascript', 'this content needs scripts', 'your browser does not support', 'active content has been', 'a script on this page'], lambda q: starts_with(line, q)))
  or list_bool_or(list_transform([' goes here', ' placeholder', ' durch klicken ergänzen', 'page not found', 'seite nicht gefunden', 'page introuvable', 'página no encontrada', 'bad gateway', 'too many requests', 'service temporarily unavailable', 'the request timed out', 'internal server error',
     'please sign in again', 'could not load the embedded object', 'unable to reach the database', 'no longer here', 'was moved or deleted', 'access to this resource is denied'], lambda q: ends_with(rtrim(line, '.'), q))) as bad
  from p left join h using (id)),
d as (select slide_key, field_name, sum(n) as words, sum(case when bad then n else 0 end) as residue from r group by slide_key, field_name)
select slide_key, field_name from d where residue * 2 > words
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}\x{34F}]"


def _looks(select: str) -> str:
    """Forms by nested replacements and the engine's own NFC."""
    from .visual_form import LOOKALIKES

    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    blanks = {chr(c): " " for c in (0x9, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    other = {"\u00b5": "\u03bc", "\u2126": "\u03a9", "\u212b": "\u00c5", "\u212a": "K"}
    for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))):  # accented look-alikes
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in LOOKALIKES and len(n := unicodedata.normalize("NFC", LOOKALIKES[d[0]] + d[1:])) == 1:
            other[c] = n
    pairs = wide | blanks | LOOKALIKES | other
    form = "replace(e, chr(13) || chr(10), chr(10))"
    form = f"regexp_replace({form}, '{INVISIBLE}', '', 'g')"
    for ligature, parts in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        form = f"replace({form}, '{ligature}', '{parts}')"
    form = f"nfc_normalize(translate({form}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))}))"
    return f"""
with t as (select distinct 'slide' as record_type, slide_key as key, list_transform(text, lambda e: coalesce(e, '')) as raw from slides where text is not null
 union all select distinct 'problem', problem_key, [description] from problems where description is not null),
f as (select *, list_transform(raw, lambda e: {form}) as form from t)
{select}"""


def _garbled() -> str:
    """Slides that hold what a letter or sign of the languages in use becomes when its UTF-8 bytes are read one by one, letters read in another alphabet, or the replacement character."""
    letters = [chr(c) for a, b in ((0xA1, 0x17F), (0x400, 0x45F), (0x904, 0x94D), (0x2010, 0x203A), (0x20A0, 0x20BF), (0x2190, 0x22FF), (0x2500, 0x257F), (0x25A0, 0x25FF), (0x2700, 0x27BF), (0x1F300, 0x1F6FF)) for c in range(a, b)]
    forms = set()
    for codec in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251"):
        for ch in letters:
            out = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in ch.encode())
            if not (len(out) == 2 and "\u0410" <= out[0] <= "\u042f" and unicodedata.category(out[1])[0] in "PZ"):  # a Cyrillic capital before a sign is clean too
                forms.add(out)
    values = ", ".join(f"({_quoted(f)})" for f in sorted(forms))
    return f"""
with s as (select distinct on (slide_key) slide_key, array_to_string(list_filter(text, lambda e: e is not null), chr(10)) as t from slides where text is not null),
runs as (select slide_key, unnest(regexp_extract_all(t, '[^\\x00-\\x7F]+')) as r from s),
grams as (select distinct slide_key, r, substr(r, i, n) as g from runs, range(1, 40) i(i), range(2, 5) n(n) where i + n - 1 <= length(r)),
forms as (select * from (values {values}) v(g))
select distinct slide_key from grams join forms using (g)
union select slide_key from s where contains(t, chr(65533)) or regexp_matches(t, '[\\x{{C0}}-\\x{{FF}}]{{5}}')
"""


_PAIRS = "select a.record_type, a.key as key_a, b.key as key_b from f a join f b on a.record_type = b.record_type and a.form = b.form and a.key < b.key and a.raw <> b.raw"
_FORMS = """select record_type, key, array_to_string(form, chr(30)) as form from f
union all select distinct 'slide', slide_key, null from slides where text is null union all select distinct 'problem', problem_key, null from problems where description is null"""
_TEMPLATES = f"""with repeated as (select ps_id, line, n from ({_LINES.replace("select ps_id, line from counts", "select ps_id, line, n from counts")})),
r as (select *, string_split(line, ' ') as w from repeated),
g as (select ps_id, len(w) as k, array_to_string(list_slice(w, 1, 5), ' ') as head, count(*) as n_lines, max(n) as n_docs, list(w) as ws from r group by 1, 2, 3)
select ps_id, array_to_string(list_transform(range(1, k + 1), lambda i: case when len(list_distinct(list_transform(ws, lambda x: x[i]))) = 1 then ws[1][i] else '*' end), ' ') as template, n_lines, n_docs from g"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _looks(_PAIRS), "p1_forms": _looks(_FORMS), "p2_found": _SETS, "p2_classes": _CLASSES, "p3_found": _garbled(), "p4_found": _RESIDUE, "p5_found": _LINES, "p5_clean": _CLEAN, "p5_templates": _TEMPLATES,
        "p6_found": _TOP.format(cols="ps_id, submission_id"), "p6_ranked": _TOP.format(cols="ps_id, submission_id, rank_in_group::int as rank_in_group"),
    }
