"""SQL of the engine's queries, for DuckDB over the same tables."""

from __future__ import annotations

_BOX = """boxes as (select label as slide, vec_id as id, 0.5 + embedding[1]::double as x, 0.5 + embedding[2]::double as y, abs(embedding[3]::double) as w, abs(embedding[4]::double) as h from embeddings),
e as (select *, x + w as r, y + h as b, w * h as area from boxes)"""
_PAIR = f"""with {_BOX}, pq as (select p.slide, p.id as first_id, q.id as second_id, p.x as px, p.y as py, p.w as pw, p.h as ph, p.r as pr, p.b as pb, p.area as pa,
 q.x as qx, q.y as qy, q.w as qw, q.h as qh, q.r as qr, q.b as qb, q.area as qa, least(p.r, q.r) - greatest(p.x, q.x) as sx, least(p.b, q.b) - greatest(p.y, q.y) as sy
 from e p join e q on p.slide = q.slide and p.id < q.id)"""


def _union(boxes: str) -> str:
    """CTEs that end in ``cov`` and ``slab`` over a CTE of boxes (slide, x, y, w, h)."""
    return f"""c as (select slide, greatest(0.0, least(1.0, x)) as l, greatest(0.0, least(1.0, x + w)) as r, greatest(0.0, least(1.0, y)) as t, greatest(0.0, least(1.0, y + h)) as b from {boxes}),
ed as (select distinct slide, unnest([l, r, 0.0::double, 1.0::double]) as x0 from c),
sl as (select slide, row_number() over (partition by slide order by x0) as k, x0, lead(x0) over (partition by slide order by x0) as x1 from ed),
slab as (select * from sl where x1 > x0),
cov as (select s.slide, s.k, s.x0, s.x1, c.t, c.b, coalesce(max(c.b) over (partition by s.slide, s.k order by c.t, c.b rows between unbounded preceding and 1 preceding), 0.0) as reach
 from slab s join c on c.slide = s.slide and c.l <= s.x0 and c.r >= s.x1 where c.r > c.l and c.b > c.t)"""


_AREA = "sum(greatest(0.0, b - greatest(t, reach)) * (x1 - x0))"
_SLIDES = "sd as (select distinct on (slide_key) slide_key, deck_id, slide_number, text, visibility, hyperlinks from slides)"
_SL2 = "sf as (select distinct on (slide_key) slide_key, deck_id, slide_number, flow_present, flow_direction from slides)"
_SQUEEZE = "trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
_BLOCKS = f"""{_SLIDES}, raw as (select slide_key, deck_id, slide_number, unnest(text) as t, generate_subscripts(text, 1) - 1 as block_no from sd),
blocks as (select slide_key, deck_id, slide_number, block_no, {_SQUEEZE.format("t")} as text from raw where t is not null and {_SQUEEZE.format("t")} <> '')"""
_WORD = "[A-Za-z0-9]+(?:[''’/-][A-Za-z0-9]+)*"
_LINKLESS = "regexp_replace({}, '(?i)(https?://|www\\.)[^\\s\\p{{Z}}]+', '', 'g')"
_FLAGS = """select *, not paragraph_like and (words <= 18 or is_label or is_bullet) as pointer_like from (select *, words >= 45 or chars >= 240 or sentences >= 3 as paragraph_like from p0)"""
_P0 = f"""length(text) as chars, len(regexp_extract_all(text, '{_WORD}')) as words, len(regexp_extract_all({_LINKLESS.format("text")} || ' ', '[.!?][\\s\\p{{Z}}]')) as sentences,
 regexp_matches({_LINKLESS.format("text")}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])[A-Za-z][A-Za-z0-9 /&+()''-]{{1,30}}:') as is_label, regexp_matches(text, '(^|[\\s\\p{{Z}}])[•▪◦●◉‣*-][\\s\\p{{Z}}]') as is_bullet"""
_PROFILE = f"{_BLOCKS}, p0 as (select slide_key, deck_id, slide_number, block_no, {_P0} from blocks), prof as ({_FLAGS})"
_BROAD = "advanced|better|comprehensive|cost effective|cost-effective|efficient|fast|improved|intelligent|optimized|quick|real time|real-time|robust|scalable|secure|seamless"
_FILL = "innovative solution|cutting edge|cutting-edge|game changer|game-changing|revolutionary|seamless experience|unlock the potential|leverage the power|transform the way|next generation|user friendly|user-friendly|end to end|end-to-end|powered by ai"
_SPECIFIC = "(?i)\\p{Nd}|%|(^|[^\\p{L}\\p{M}\\p{N}_])(accuracy|baseline|benchmark|demo|github|latency|measure|metric|ms|percent|reference|source|target|test|throughput|validated|users?|devices?|requests?)([^\\p{L}\\p{M}\\p{N}_]|$)|(^|[^\\p{L}\\p{M}\\p{N}_])(using|via|through|with)[\\s\\p{Z}]+[A-Za-z0-9]"
_HAS = "regexp_matches({}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(' || {} || ')([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"


def _terms_in(c: str, terms: str) -> str:
    """The terms of a list that a text holds, each by a constant pattern."""
    return "list_filter([" + ", ".join(f"case when {_HAS.format(c, chr(39) + t + chr(39))} then '{t}' end" for t in terms.split("|")) + "], lambda x: x is not null)"


_CLAIMS = f"""cs as (select slide_key, block_no, unnest(string_split(regexp_replace({_LINKLESS.format("text")}, '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1))) as s from blocks),
 cv as (select * from cs where len(regexp_extract_all(s, '{_WORD}')) >= 4 and not regexp_matches(s, '{_SPECIFIC}')),
 ct as (select slide_key, block_no, unnest({_terms_in("s", _BROAD)}) as term from cv), claims as (select slide_key, block_no, string_agg(distinct term, ',' order by term) as terms from ct group by slide_key, block_no)"""
_STRUCTURE = f"""{_PROFILE}, {_CLAIMS}, body as (select p.*, c.terms is not null as broad, {_HAS.format("b.text", f"'{_FILL}'")} as filler from prof p join blocks b using (slide_key, block_no) left join claims c using (slide_key, block_no)
  where block_no > (select min(block_no) from blocks m where m.slide_key = p.slide_key)),
 st as (select sd.deck_id, sd.slide_key, coalesce(sum(chars), 0) as c, coalesce(sum(chars) filter (paragraph_like), 0) as pc, coalesce(sum(chars) filter (pointer_like), 0) as oc, count(*) filter (broad) as nb, count(*) filter (filler) as nf, count(chars) as n from sd left join body using (slide_key) group by 1, 2),
 sc as (select *, case when c = 0 then 0.0 else greatest(0.0, (case when pc / c <= 0.35 then 1.0 else greatest(0.0, (1 - pc / c) / (1 - 0.35)) end) - least(0.25, 0.05 * nb)) end as score from st)"""
_PHASES = {
    "problem": ["problem", "challenge", "pain point", "need", "objective", "requirement"], "solution": ["solution", "approach", "proposed", "how it works", "workflow", "process"],
    "build": ["architecture", "system design", "implementation", "technology", "tech stack", "model"], "evidence": ["prototype", "demo", "result", "evaluation", "validation", "testing", "benchmark", "metric"],
    "close": ["conclusion", "summary", "next step", "roadmap", "future work", "thank you"],
}
_TYPES = {"architecture": ["architecture", "system design", "component"], "process": ["workflow", "process", "pipeline", "steps"], "results": ["result", "output", "evaluation", "performance"], "comparison": ["comparison", "versus", " vs "]}


def _first(kinds: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {' or '.join(f"contains(t, '{x}')" for x in xs)} then '{n}'" for n, xs in kinds.items()) + " end"


_KINDS = f"""{_SLIDES}, kt as (select slide_key, deck_id, slide_number, lower(coalesce({_SQUEEZE.format("array_to_string(list_filter(text, lambda x: x is not null), ' ')")}, '')) as t from sd),
 kinds as (select *, {_first(_PHASES)} as phase, coalesce({_first(_TYPES)}, 'content') as slide_type from kt)"""
_FLOW = f"""{_KINDS}, ke as (select *, min(slide_number) over (partition by deck_id) as lo, max(slide_number) over (partition by deck_id) as hi, count(*) over (partition by deck_id) as n_slides from kinds),
 kp as (select deck_id, slide_number, slide_type, coalesce(phase, case when t <> '' and n_slides > 1 and slide_number = lo then 'problem' when t <> '' and n_slides > 1 and slide_number = hi then 'close' end) as phase from ke),
 kf as (select deck_id, {', '.join(f"min(slide_number) filter (phase = '{n}') as p{i}" for i, n in enumerate(_PHASES))}, avg((slide_type in ('process', 'architecture'))::int) as signal from kp group by deck_id),
 kg as (select *, list_filter([p0, p1, p2, p3, p4], lambda x: x is not null) as p from kf),
 kh as (select *, len(p) as n, len(list_filter(range(1, len(p)), lambda i: p[i] <= p[i + 1])) as steps from kg),
 flow as (select deck_id, round(n / 5, 6) as coverage, round(steps / greatest(n - 1, 1), 6) as ordered, (p0 is not null)::int as opening, (p4 is not null)::int as closing,
  round(0.4 * n / 5 + 0.3 * steps / greatest(n - 1, 1) + 0.2 * (p0 is not null)::int + 0.1 * greatest((p4 is not null)::int, signal), 6) as flow from kh)"""
_VISIBLE = f"""{_SLIDES}, vq as (select deck_id, list_filter([visibility.native, visibility.rendered, visibility.ocr, visibility.vision], lambda x: x is not null and x not in ('not_requested', 'not_applicable')) as q,
  len(list_filter(coalesce(text, []), lambda x: x is not null and {_SQUEEZE.format("x")} <> '')) > 0 as shown from sd),
 vis as (select deck_id, round(case when len(q) > 0 then len(list_filter(q, lambda x: x in ('verified', 'partial'))) / len(q) when shown then 1.0 else 0.0 end, 6) as v from vq)"""
_ASSETS = "ad as (select distinct on (deck_id, asset_id) deck_id, asset_id, part_name, content_type, size_bytes, nullif(lower(trim(sha256)), '') as h from assets)"
_DECKS = "dd as (select distinct on (deck_id) * exclude (loaded_at) from decks)"
_PROBLEMS = "pd as (select distinct on (problem_key) * exclude (loaded_at) from problems)"
_PID = "coalesce(nullif(upper(regexp_replace(regexp_replace(regexp_replace(trim(ps_id), '^(sih|problem|ps)[\\s:#._-]*(statement)?[\\s:#._-]*(id)?[\\s:#._-]*', '', 'i'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'UNASSIGNED')"
_PIDOF = "coalesce(nullif(upper(regexp_replace(regexp_replace(regexp_replace(trim({}), '^(sih|problem|ps)[\\s:#._-]*(statement)?[\\s:#._-]*(id)?[\\s:#._-]*', '', 'i'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'UNASSIGNED')"
_NAMED = f"""{_SLIDES}, {_DECKS}, ntx as (select deck_id, string_agg(coalesce(array_to_string(list_filter(text, lambda x: x is not null), chr(10)), ''), chr(10) order by slide_number, slide_key) as text from sd group by deck_id),
 nt as (select deck_id, text, regexp_replace(deck_name, '([^.])\\.[^.]+$', '\\1') as stem from ntx full join dd using (deck_id))"""
_FIN = "case when isnan({0}) then null else {0} + 0.0 end"
_LATEST = f"""lt as (select ps_id, submission_id, unnest(max(struct_pack(scored_at := scored_at, final_score := final_score, proposal_score := proposal_score, deck_quality_score := deck_quality_score, status := status))) from submissions group by ps_id, submission_id),
fin as (select ps_id, submission_id, status, {_FIN.format("final_score")} as final_score, {_FIN.format("proposal_score")} as proposal_score, {_FIN.format("deck_quality_score")} as deck_quality_score from lt)"""
_BOARD = f"""{_LATEST}, ok as (select *, row_number() over (partition by ps_id order by final_score desc, coalesce(proposal_score, 0) desc, coalesce(deck_quality_score, 0) desc, lower(submission_id), submission_id) as place
 from fin where final_score is not null and status <> 'failed'),
board as (select f.ps_id, f.submission_id, f.final_score, case when f.final_score is null then 'REVIEW' when f.final_score >= 85 then 'A - Excellent' when f.final_score >= 70 then 'B - Strong' when f.final_score >= 55 then 'C - Promising' else 'D - Needs work' end as bucket, ok.place
 from fin f left join ok using (ps_id, submission_id))"""
_CALIB = f"{_LATEST}, cal as (select proposal_score / 100 as confidence, (final_score >= 60)::int as y from fin where final_score is not null)"
_NEXT = f"{_SLIDES}, tx as (select slide_key, deck_id, slide_number, coalesce(array_to_string(list_filter(text, lambda x: x is not null), ' '), '') as t from sd), nx as (select a.slide_key, a.t, b.t as u from tx a join tx b on a.deck_id = b.deck_id and a.slide_number = b.slide_number - 1)"
_LINES = "long as (select slide, id, unnest([{'edge': 'left', 'v': round(x, 6)}, {'edge': 'center_x', 'v': round(x + w / 2, 6)}, {'edge': 'right', 'v': round(r, 6)}, {'edge': 'top', 'v': round(y, 6)}, {'edge': 'center_y', 'v': round(y + h / 2, 6)}, {'edge': 'bottom', 'v': round(b, 6)}], recursive := true) from e)"


def _anchored(source: str, keys: str, value: str, tolerance: float) -> str:
    """CTEs that end in ``anch`` (keys, v, anchor), by jumping from each cluster's first value to the next cluster's."""
    on = " and ".join(f"a.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    return f"""vals as (select distinct {keys}, {value} as v from {source}),
starts as (select {keys}, min(v) as anchor from vals group by {keys} union all
 select {", ".join("a." + k.strip() for k in keys.split(","))}, (select min(v.v) from vals v where {on} and v.v - a.anchor > {tolerance}) as anchor from starts a where a.anchor is not null),
anch as (select {", ".join("v." + k.strip() for k in keys.split(","))}, v.v, max(a.anchor) as anchor from vals v join starts a on {on} and a.anchor <= v.v group by all)"""


_RAWTEXT = "array_to_string(list_filter(text, lambda x: x is not null), ' ')"
_METRICS = f"""{_STRUCTURE}, dn as (select s.deck_id, s.slide_key, s.slide_number, round(least(1.0, length({_RAWTEXT}) / 1200.0), 6) as density, case when flow_present then 0.3 else 0.0 end as area, c, score, n, nf,
  exists (select 1 from blocks b where b.slide_key = s.slide_key) as titled, nullif(replace(lower({_SQUEEZE.format("coalesce(" + _RAWTEXT + ", '')")}), 'ß', 'ss'), '') as folded, lower({_SQUEEZE.format("coalesce(" + _RAWTEXT + ", '')")}) as t
  from (select distinct on (slide_key) * from slides) s join sc using (slide_key)),
 dt as (select *, coalesce({_first(_TYPES)}, 'content') as slide_type, coalesce(density, 0) as dz from dn),
 db as (select *, round(greatest(0.0, least(1.0, 1.0 - 0.5 * (case when c > 0 then greatest(0.0, least(1.0, (dz - 0.32) / 0.48)) else 0 end) - 0.25 * (greatest(0.0, least(1.0, (area - 0.7) / 0.3)) * greatest(0.0, least(1.0, (90.0 - c) / 90.0)))
   - 0.15 * (case when (slide_type in ('architecture', 'process', 'results', 'comparison') or c >= 180) and area < 0.08 then least(1.0, (0.08 - area) / 0.08) else 0 end) - 0.1 * (case when area >= 0.25 and c < 55 then least(1.0, (55.0 - c) / 55.0) else 0 end))), 6) as bal,
  round(least(1.0, area / 0.25), 6) as cov, coalesce(round(1 - density, 6), 1.0) as white from dt),
 ds as (select *, round(greatest(0.0, 1.0 - 0.65 * greatest(0.0, (white - 0.35) / 0.65) - 0.35 * greatest(0.0, (white - 0.2) / 0.8)), 6) as spc from db),
 dm as (select deck_id, round(avg(titled::int), 6) as title_coverage, round(avg(density), 6) as text_density, count(*) filter (density is null)::int as missing_text_density, round(stddev_pop(density), 6) as content_density_variation,
  round(avg(score), 6) as structure_score, round(sum(nf) / nullif(sum(n), 0), 6) as generic_filler_ratio, round(avg(bal), 6) as text_visual_balance, count(*) filter (bal < 0.6)::int as n_unbalanced, round(avg(cov), 6) as visual_coverage, round(avg(spc), 6) as space_usage,
  round((count(folded) - count(distinct folded)) / nullif(count(folded), 0), 6) as duplicate_content, 0.35 as visual_relevance_coherence from ds group by deck_id)"""
_KINDS2, _FLOW2 = _KINDS.replace(_SLIDES + ", ", ""), _FLOW.replace(_SLIDES + ", ", "")
_METRICS = f"""{_METRICS}, {_FLOW2}, {_VISIBLE.replace(_SLIDES + ", ", "")}, vd as (select deck_id, round(avg(v), 6) as evidence_visibility from vis group by deck_id),
 mt as (select dm.*, evidence_visibility, flow as narrative_flow, (5 - round(coverage * 5))::int as n_phases_missing from dm join vd using (deck_id) join flow using (deck_id))"""
_SCORES = f"""{_METRICS}, r0 as (select *, least(8.0, 10 * coalesce(generic_filler_ratio, 0)) as fd from mt),
 r1 as (select deck_id, round(100 * text_visual_balance, 6) as s1, n_unbalanced as m1, round(greatest(0, 100 * structure_score - fd), 6) as s2, round(100 * (0.35 * title_coverage + 0.65), 6) as s3, round(100 * narrative_flow, 6) as s4, n_phases_missing as m4, 35.0 as s5,
  round(100 * (0.6 * space_usage + 0.2 * (1 - least(1.0, greatest(0.0, content_density_variation) / 0.2)) + 0.2), 6) as s6 from r0),
 r2 as (select *, least(s1, 10 * m1) as l1, least(s4, 10 * m4) as l4 from r1),
 r3 as (select deck_id, round((8 * (s1 - l1) + 5 * s2 + 5 * s3 + 4 * (s4 - l4) + 5 * s5 + 3 * s6) / 30, 6) as s, round((8 * l1 + 4 * l4) / 30, 6) as off, round((8 * (case when m1 > 0 then 0.75 else 1 end) + 4 * (case when m4 > 0 then 0.75 else 1 end) + 18) / 30, 6) as sure from r2),
 r4 as (select *, round(greatest(0, round(s * 0.3, 6)) / 0.3, 6) as deck_score from r3),
 pr as (select deck_id, max(case when isnan(proposal_score) then null else proposal_score end) as p from submissions where deck_id is not null group by deck_id),
 fs as (select deck_id, round(p, 6) as proposal_score, deck_score, off as deck_penalty, sure as deck_confidence, round(round(round(p, 6) * 0.7, 6) + round(deck_score * 0.3, 6), 6) as final_score from r4 left join pr using (deck_id))"""

_METRICS, _SCORES = (x.replace(", 6)", " + 1e-9, 6)") for x in (_METRICS, _SCORES))  # halves are rounded up


SQL: dict[str, str] = {
    "overlap_pairs": f"{_PAIR} select slide, first_id, second_id, round(sx * sy, 6) as intersection, round(sx * sy / least(pa, qa), 6) as of_smaller, round(sx * sy / (pa + qa - sx * sy), 6) as iou from pq where sx > 0 and sy > 0",
    "alignment_mismatch": f"""{_PAIR}, d as (select slide, first_id, second_id, unnest([{{'o': 'left', 'f': sx / least(pw, qw), 'd': abs(px - qx)}}, {{'o': 'right', 'f': sx / least(pw, qw), 'd': abs(pr - qr)}},
 {{'o': 'center_x', 'f': sx / least(pw, qw), 'd': abs(px + pw / 2 - (qx + qw / 2))}}, {{'o': 'top', 'f': sy / least(ph, qh), 'd': abs(py - qy)}}, {{'o': 'bottom', 'f': sy / least(ph, qh), 'd': abs(pb - qb)}},
 {{'o': 'center_y', 'f': sy / least(ph, qh), 'd': abs(py + ph / 2 - (qy + qh / 2))}}], recursive := true) from pq where pw > 0 and ph > 0 and qw > 0 and qh > 0),
 n as (select *, row_number() over (partition by slide, first_id, second_id order by d, o) as k from d where f >= 0.75 and d > 0.005 and d <= 0.05) select slide, first_id, second_id, o as edge, round(d, 6) as distance from n where k = 1""",
    "union_area": f"with {_BOX}, {_union('boxes')}, a as (select slide, {_AREA} as a from cov group by slide) select slide, n_boxes, round(coalesce(a, 0), 6) as union_area from (select slide, count(*) as n_boxes from boxes group by slide) left join a using (slide)",
    "empty_regions": f"""with {_BOX}, {_union('boxes')}, gaps as (select slide, k, x0, x1, reach as g0, t as g1 from cov where t > reach union all
 select s.slide, s.k, s.x0, s.x1, coalesce(m.b, 0.0), 1.0 from slab s left join (select slide, k, max(b) as b from cov group by slide, k) m using (slide, k) where coalesce(m.b, 0.0) < 1.0),
 runs as (select *, k - row_number() over (partition by slide, g0, g1 order by k) as run from gaps),
 g as (select slide, g0, g1, min(x0) as x0, max(x1) as x1, round((max(x1) - min(x0)) * (g1 - g0), 6) as area from runs group by slide, g0, g1, run),
 n as (select *, row_number() over (partition by slide order by area desc, g0, x0, x1, g1) as place from g)
 select slide, place::int as place, round(x0, 6) as x0, round(x1, 6) as x1, round(g0, 6) as top, round(g1, 6) as bottom, area from n where place <= 64""",
    "margins": f'with {_BOX} select slide, round(min(x), 6) as "left", round(min(y), 6) as top, round(1 - max(r), 6) as "right", round(1 - max(b), 6) as bottom, round(max(r) - min(x), 6) as occupied_w, round(max(b) - min(y), 6) as occupied_h from e group by slide',
    "clipping": f"""with {_BOX}, f as (select slide, id, x, y, x + w * 4 as r, y + h * 4 as b, (w * 4) * (h * 4) as area from boxes),
 g as (select *, (greatest(0.0, least(1.0, r)) - greatest(0.0, least(1.0, x))) * (greatest(0.0, least(1.0, b)) - greatest(0.0, least(1.0, y))) as inside,
 concat_ws(',', case when x < 0 then 'left' end, case when y < 0 then 'top' end, case when r > 1 then 'right' end, case when b > 1 then 'bottom' end) as sides from f)
 select slide, id, sides, round(coalesce((area - inside) / nullif(area, 0), 0), 6) as outside_share from g where sides <> ''""",
    "whitespace_balance": f"""with {_BOX}, parts as (select * from (values ('all', 0.0, 0.0, 1.0, 1.0), ('l', 0.0, 0.0, 0.5, 1.0), ('r', 0.5, 0.0, 1.0, 1.0), ('t', 0.0, 0.0, 1.0, 0.5), ('b', 0.0, 0.5, 1.0, 1.0)) as v(part, x0, y0, x1, y1)),
 cl as (select slide || '/' || part as slide, greatest(x0, least(x1, x)) as x, greatest(y0, least(y1, y)) as y, greatest(x0, least(x1, x + w)) - greatest(x0, least(x1, x)) as w, greatest(y0, least(y1, y + h)) - greatest(y0, least(y1, y)) as h from boxes, parts),
 {_union('cl')}, a as (select slide, round({_AREA}, 6) as a from cov group by slide),
 al as (select distinct split_part(slide, '/', 1)::int as slide from cl),
 p as (select s.slide, {', '.join(f"coalesce((select a from a where a.slide = s.slide || '/{k}'), 0.0) as {n}" for k, n in (('all', 'w'), ('l', 'l'), ('r', 'r'), ('t', 't'), ('b', 'b')))} from al s),
 q as (select slide, 1 - w as ws, coalesce(1 - abs(l - r) / nullif(l + r, 0), 1) as hb, coalesce(1 - abs(t - b) / nullif(t + b, 0), 1) as vb from p)
 select slide, round(ws, 6) as whitespace, round(hb, 6) as horizontal, round(vb, 6) as vertical, round((hb + vb) / 2, 6) as balance from q""",
    "alignment_groups": f"with recursive {_BOX}, {_LINES}, {_anchored('long', 'slide, edge', 'v', 0.005000001)} select slide, edge, anchor, count(*) as n_boxes, min(id) as first_id, max(id) as last_id from long join anch using (slide, edge, v) group by slide, edge, anchor having count(*) >= 2",
    "equal_spacing": f"""with recursive {_BOX}, cy as (select *, round(y + h / 2, 6) as v from boxes), {_anchored('cy', 'slide', 'v', 0.010000001)},
 n as (select slide, anchor, id as id_1, lead(id, 1) over o as id_2, lead(id, 2) over o as id_3, lead(x, 1) over o - x - w as g1, lead(x, 2) over o - lead(x, 1) over o - lead(w, 1) over o as g2 from cy join anch using (slide, v) window o as (partition by slide, anchor order by x, id))
 select slide, anchor as row_at, id_1, id_2, id_3, round((g1 + g2) / 2, 6) as gap from n where id_3 is not null and least(g1, g2) >= -0.005 and (g1 + g2) / 2 > 0.005 and abs(g1 - g2) <= greatest(0.005, 0.05 * (g1 + g2) / 2)""",
    "peer_groups": f"with {_BOX} select slide, round(w, 2) as w, round(h, 2) as h, count(*) as n_boxes, min(id) as first_id from boxes group by slide, round(w, 2), round(h, 2) having count(*) >= 3",
    "nearest_box": f"""with {_BOX}, d as (select p.slide, p.id, q.id as other, round(sqrt(pow(greatest(q.x - (p.x + p.w / 2), p.x + p.w / 2 - q.r, 0), 2) + pow(greatest(q.y - (p.y + p.h / 2), p.y + p.h / 2 - q.b, 0), 2)), 6) as d from e p join e q on p.slide = q.slide and p.id <> q.id),
 n as (select *, row_number() over (partition by slide, id order by d, other) as k from d) select slide, id, other as nearest_id, d as distance from n where k = 1 and d <= 0.08""",
    "box_reading_order": f"with {_BOX} select slide, case when count(*) < 2 then 'unknown' when max(y) - min(y) <= greatest(0.04, 1.5 * median(h)) then 'left_to_right' when max(x) - min(x) <= greatest(0.04, 1.5 * median(w)) then 'top_to_bottom' else 'unknown' end as reading_order from boxes group by slide",
    "text_profile": f"with {_PROFILE} select * replace (block_no::int as block_no, chars::int as chars, words::int as words, sentences::int as sentences) from prof",
    "content_structure": f"""with {_STRUCTURE} select deck_id, round(case when sum(c) = 0 then 0 else sum(pc) / sum(c) end, 6) as paragraph_ratio, round(case when sum(c) = 0 then 0 else sum(oc) / sum(c) end, 6) as pointer_ratio,
 round(coalesce(avg((pc / c >= 0.55)::int) filter (c > 0), 0), 6) as heavy_ratio, round(case when sum(n) = 0 then 0 else sum(nb) / sum(n) end, 6) as ambiguous_ratio, round(avg(score), 6) as structure_score from sc group by deck_id""",
    "filler_ratio": f"with {_STRUCTURE} select deck_id, sum(n)::bigint as n_blocks, round(sum(nf) / nullif(sum(n), 0), 6) as filler_ratio from sc group by deck_id",
    "filler_terms": f"with {_BLOCKS}, t as (select slide_key, block_no, deck_id, unnest({_terms_in('text', _FILL + '|' + _BROAD)}) as term from blocks) select term, count(*) as n_blocks, count(distinct deck_id) as n_decks from t group by term",
    "ambiguous_claims": f"with {_BLOCKS}, {_CLAIMS} select slide_key, block_no::int as block_no, terms from claims",
    "narrative_flow": f"with {_FLOW} select * from flow",
    "slide_types": f"with {_KINDS} select slide_type, count(*) as n_slides, count(distinct deck_id) as n_decks from kinds group by slide_type",
    "duplicate_content": f"""with {_SLIDES}, f as (select deck_id, replace(lower({_SQUEEZE.format("array_to_string(list_filter(text, lambda x: x is not null), ' ')")}), 'ß', 'ss') as t from sd where text is not null), g as (select deck_id, t, count(*) as n from f where t <> '' group by deck_id, t)
 select deck_id, sum(n)::bigint as n_slides, sum(n - 1)::bigint as n_repeats, round(sum(n - 1) / sum(n), 6) as duplicate_ratio from g group by deck_id""",
    "weighted_median_words": f"with {_PROFILE}, g as (select deck_id, words, sum(chars) as w from prof group by deck_id, words), r as (select *, sum(w) over (partition by deck_id order by words) as run, sum(w) over (partition by deck_id) as total from g) select deck_id, min(words)::int as weighted_median from r where run * 2 >= total group by deck_id",
    "evidence_visibility": f"with {_VISIBLE} select deck_id, round(avg(v), 6) as visibility, count(*) as n_slides from vis group by deck_id",
    "link_dedup": f"""with {_SLIDES}, l as (select deck_id, slide_number, unnest(hyperlinks) as l from sd), t as (select deck_id, slide_number, coalesce(l.resolved_target, l.target) as target from l),
 g as (select deck_id, target, list_sort(list_distinct(list(slide_number))) as s from t where regexp_matches(lower(target), '^(https?|mailto|ftp):|^//') group by deck_id, target) select deck_id, target, len(s)::int as n_slides, s[1] as first_slide, array_to_string(s, ',') as slides from g""",
    "slide_titles": f"with {_BLOCKS}, m as (select slide_key, arg_min(text, block_no) as t from blocks group by slide_key) select slide_key, case when length(t) > 40 then rtrim(substr(t, 1, 37)) || '...' else t end as title from m",
    "media_registry": f"with {_ASSETS} select deck_id, asset_id, printf('asset-%04d', row_number() over (partition by deck_id order by part_name nulls first, asset_id)) as ordinal_id, h as file_hash from ad",
    "repeated_media": f"with {_ASSETS}, g as (select h, deck_id, count(*) as n from ad where h is not null group by h, deck_id) select h as file_hash, count(*) as n_decks, sum(n)::bigint as n_uses from g group by h having count(*) > 1",
    "media_relevance": f"with {_ASSETS}, g as (select deck_id, h, count(*) as n from ad where h is not null group by deck_id, h) select deck_id, sum(n)::bigint as n_files, round(sum(n - 1) / sum(n), 6) as repeat_ratio, round(1 - 0.15 * (sum(n - 1) / sum(n)), 6) as relevance from g group by deck_id",
    "media_types": f"with {_ASSETS}, g as (select deck_id, content_type, count(*) as n, sum(size_bytes) as b from ad where content_type is not null group by deck_id, content_type), r as (select *, row_number() over (partition by deck_id order by n desc, content_type) as k from g) select deck_id, max(case when k = 1 then content_type end) as content_type, count(*) as n_types, sum(b)::bigint as bytes from r group by deck_id",
    "noise_reasons": f"""with {_ASSETS}, u as (select h, count(distinct deck_id) as n_decks from ad where h is not null group by h), j as (select deck_id, asset_id, concat_ws(',', case when size_bytes < 20000 then 'small' end, case when n_decks >= 5 then 'repeated' end, case when h is null then 'no_hash' end, case when content_type is null then 'no_type' end) as reasons from ad left join u using (h)) select * from j where reasons <> ''""",
    "problem_ids": f"with {_DECKS} select deck_id, {_PID} as ps_norm, coalesce(nullif(regexp_replace(regexp_replace(deck_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'deck') as slug from dd",
    "problem_resolver": f"""with {_DECKS}, {_PROBLEMS}, x as (select deck_id, {_PID} as k from dd), p as (select distinct {_PID} as k, title from pd) select k, count(*) as n_decks, max(title) as title, max(case when title is null then 'unresolved' else 'resolved' end) as state from x left join p using (k) group by k""",
    "inferred_problem": f"""with {_NAMED} select deck_id, {_PIDOF.format("coalesce(regexp_replace(nullif(regexp_extract(text, '(?i)(^|[^\\p{L}\\p{N}_])s[\\s\\p{Z}]*i[\\s\\p{Z}]*h[\\s\\p{Z}]*[-_:#]?[\\s\\p{Z}]*(\\p{Nd}([\\s\\p{Z}_-]*\\p{Nd}){4,7})([^\\p{L}\\p{N}_]|$)', 2), ''), '[\\s\\p{Z}_-]+', '', 'g'), nullif(regexp_extract(text, '(?i)problem[\\s\\p{Z}]+statement[\\s\\p{Z}]+(id|number|no)[\\s\\p{Z}]*[:#\\x{2013}\\x{2014}-]?[\\s\\p{Z}]*([A-Za-z0-9][A-Za-z0-9_-]*)', 2), ''), nullif(regexp_extract(text, '(?i)(^|[^\\p{L}\\p{N}_])ps[\\s\\p{Z}]+(id|number|no)[\\s\\p{Z}]*[:#\\x{2013}\\x{2014}-]?[\\s\\p{Z}]*([A-Za-z0-9][A-Za-z0-9_-]*)', 3), ''), nullif(regexp_extract(text, '(?i)(^|[^\\p{L}\\p{N}_])ps[\\s\\p{Z}]+(id)?[\\s\\p{Z}:#-]*([0-9]{5,8})', 3), ''), nullif(regexp_extract(stem, '(?i)(^|[-_ ()])(ps|problem[-_ ]?statement)[-_ ]*([0-9][A-Za-z0-9_-]*)', 3), ''))")} as ps_inferred from nt""",
    "inferred_team": f"""with {_NAMED} select deck_id, coalesce(nullif({_SQUEEZE.format("regexp_replace(nullif(regexp_extract(text, '(?i)team[\\s\\p{Z}]+name[\\s\\p{Z}]*[:#\\x{2013}\\x{2014}-]?[\\s\\p{Z}]*([^\\r\\n]+)', 1), ''), '^[\\s\\p{Z}•●▪*-]+', '')")}, ''), stem) as team from nt""",
    "problem_weights": f"""with {_PROBLEMS}, r as (select ps_id, unnest(requirements) as q, generate_subscripts(requirements, 1) as i from pd), s as (select ps_id, i, q.id as requirement, q.weight as weight, round(q.weight / nullif(sum(q.weight) over (partition by ps_id), 0), 6) as raw, i = max(i) over (partition by ps_id) as is_last from r)
 select ps_id, requirement, weight, round(case when is_last then 1.0 - sum(case when is_last then 0.0 else raw end) over (partition by ps_id) else raw end, 6) as share from s""",
    "leaderboard": f"with {_BOARD} select * replace (place::int as place) from board",
    "leaderboard_lines": f"""with {_BOARD} select ps_id, submission_id, printf('| %s | %s | %s | %s | %s | %s |', coalesce(place::varchar, 'REVIEW'), replace(submission_id, '|', '\\|'), ps_id, bucket, case when final_score is null then 'N/A' else printf('%.2f', final_score) end, coalesce(status, '–')) as line from board join fin using (ps_id, submission_id, final_score)
 union all select ps_id, submission_id, printf('| REVIEW | %s | %s | %s | N/A | %s |', replace(submission_id, '|', '\\|'), ps_id, bucket, coalesce(status, '–')) from board join fin using (ps_id, submission_id) where board.final_score is null""",
    "bucket_counts": f"with {_BOARD} select bucket, count(*) as n, round(avg(final_score), 4) as mean_score from board group by bucket",
    "score_summary": f"with {_LATEST} select ps_id, count(*) as n, count(final_score) as n_scored, round(avg(final_score), 4) as mean_score, round(stddev_pop(final_score), 4) as deviation, round(median(final_score), 4) as median_score, min(final_score) as lowest, max(final_score) as highest from fin group by ps_id",
    "weighted_group": f"""with lt as (select ps_id, submission_id, unnest(max(struct_pack(scored_at := scored_at, proposal_score := proposal_score, deck_quality_score := deck_quality_score, team := team))) from submissions group by ps_id, submission_id),
 f as (select ps_id, submission_id, {_FIN.format('proposal_score')} as a, {_FIN.format('deck_quality_score')} as b, 10.0 * (team is null)::int as m from lt),
 g as (select *, a is not null and b is not null as ok, least(a, m) as pa, least(b, m) as pb from f)
 select ps_id, submission_id, case when ok then round(0.7 * (a - pa) + 0.3 * (b - pb), 6) end as score, case when ok then round(0.7 * a + 0.3 * b, 6) end as unpenalized, case when ok then round(0.7 * pa + 0.3 * pb, 6) end as penalty from g""",
    "calibration_bins": f"""with {_CALIB}, g as (select least(9, floor(confidence * 10)::int) as bin, count(*) as n, avg(confidence) as c, avg(y) as a from cal where confidence is not null group by 1)
 select r.bin::int as bin, coalesce(n, 0) as n, round(c, 6) as confidence, round(a, 6) as accuracy, round(abs(c - a), 6) as gap from range(10) as r(bin) left join g on g.bin = r.bin""",
    "calibration_error": f"with {_CALIB}, g as (select least(9, floor(confidence * 10)::int) as bin, count(*) as n, sum(confidence) as c, sum(y) as a, sum(pow(confidence - y, 2)) as q from cal where confidence is not null group by 1) select sum(n)::bigint as n, round(sum(abs(c - a)) / sum(n), 6) as ece, round(sum(q) / sum(n), 6) as brier from g",
    "word_prf": f"""with {_NEXT}, wa as (select slide_key, unnest(regexp_extract_all(lower(t), '{_WORD}')) as w from nx), wb as (select slide_key, unnest(regexp_extract_all(lower(u), '{_WORD}')) as w from nx),
 a as (select slide_key, w, count(*) as a from wa group by slide_key, w), b as (select slide_key, w, count(*) as b from wb group by slide_key, w),
 g as (select slide_key, sum(coalesce(a, 0)) as x, sum(coalesce(b, 0)) as y, sum(least(coalesce(a, 0), coalesce(b, 0))) as m from a full join b using (slide_key, w) group by slide_key),
 h as (select *, case when y = 0 then case when x = 0 then 1.0 else 0.0 end else m / y end as p, case when x = 0 then 1.0 else m / x end as r from g)
 select slide_key, x::bigint as n_reference, y::bigint as n_hypothesis, m::bigint as n_matched, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) as f1 from h""",
    "character_error": f"""with {_BLOCKS}, t as (select * from blocks where block_no = 0), p as (select a.slide_key, a.text as t, b.text as u from t a join t b on a.deck_id = b.deck_id and a.slide_number = b.slide_number - 1),
 c as (select *, array_to_string(list_distinct(regexp_extract_all(t || u, '(?s).')), '') as chars from p), b as (select array_to_string(list_transform(range(1, 127), lambda i: chr(i::int)), '') as bytes),
 q as (select slide_key, translate(t, chars, left(bytes, length(chars))) as t, translate(u, chars, left(bytes, length(chars))) as u from c, b)
 select slide_key, levenshtein(t, u)::int as distance, round(levenshtein(t, u) / length(t), 6) as cer from q""",
    "completeness": """with e as (select distinct deck_id from decks), r as (select distinct deck_id from assets) select deck_id, 'missing' as state from (select * from e except select * from r) union all select deck_id, 'unexpected' from (select * from r except select * from e)""",
    "contract_violations": f"""with {_DECKS}, {_SLIDES}, n as (select deck_id, count(*) as n from sd group by deck_id), x as (select dd.*, n from dd left join n using (deck_id)),
 v as (select 'slide_count_differs' as rule, deck_id from x where slide_count <> coalesce(n, 0) union all select 'no_slides', deck_id from x where n is null union all select 'no_slide_count', deck_id from x where slide_count is null
 union all select 'no_statement', deck_id from x where ps_id is null union all select 'asset_without_deck', deck_id from (select distinct deck_id from assets where deck_id not in (select deck_id from dd)))
 select rule, count(*) as n, min(deck_id) as first_deck from v group by rule""",
    "upsert_scores": f"""with x as (select ps_id, submission_id, scored_at >= timestamp '2025-06-20' as part, unnest(max(struct_pack(scored_at := scored_at, final_score := final_score, status := status))) from submissions group by 1, 2, 3)
 select distinct on (ps_id, submission_id) ps_id, submission_id, scored_at, {_FIN.format("final_score")} as final_score, status from x order by ps_id, submission_id, part desc""",
    "as_of_view": """with p as (select event_id, user_id, ts, value as paid from events where event_type = 'purchase'), v as (select user_id, ts, max(value) as seen from events where event_type = 'view' group by user_id, ts)
 select event_id, round(paid, 6) as paid, round(seen, 6) as seen from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""",
    "media_components": f"""with recursive {_ASSETS}, s as (select distinct deck_id, h from ad where h is not null and deck_id is not null), n as (select h, min(deck_id) as u from s group by h having count(*) >= 2), ed as (select distinct u, deck_id as v from s join n using (h) where u < deck_id),
 bi as (select u as a, v as b from ed union select v, u from ed), nodes as (select distinct a from bi),
 least_of(a, c, k) as (select a, a, 0 from nodes union all select a, min(c), k from (select l.a, l.c, l.k + 1 as k from least_of l where k < 12 union all select bi.b, l.c, l.k + 1 from least_of l join bi on bi.a = l.a where k < 12) group by a, k)
 select a as deck_id, min(c) as component from least_of where k = 12 group by a""",
    "shared_hashes": f"""with {_ASSETS}, j as (select h, lower(source_format) as f from ad join (select distinct deck_id, source_format from decks) using (deck_id) where h is not null), x as (select distinct h from j where f = 'pdf'), y as (select distinct h from j where f <> 'pdf')
 select 'both' as part, count(*) as n from (select * from x intersect select * from y) union all select 'pdf_only', count(*) from (select * from x except select * from y) union all select 'any', count(*) from (select * from x union select * from y)""",
    "grounding": f"""with {_PROBLEMS}, r as (select ps_id, lower(concat_ws(' ', title, description)) as t, unnest(requirements) as q from pd), s as (select ps_id, len(list_filter(regexp_extract_all(lower(q.description), '[a-z]{{6,}}'), lambda w: contains(t, w))) > 0 as ok from r)
 select ps_id, count(*) as n_requirements, round(avg(ok::int), 6) as grounded from s group by ps_id""",
    "deck_profile": f"""with {_DECKS}, {_SLIDES}, {_ASSETS}, s as (select deck_id, count(*) as n_slides, sum(len(coalesce(text, []))) as n_blocks from sd group by deck_id), a as (select deck_id, count(*) as n_assets, sum(size_bytes) as bytes from ad group by deck_id)
 select deck_id, lower(source_format) as source_format, round(coalesce(aspect_ratio, round(width / nullif(height, 0), 12)), 6) as aspect, coalesce(n_slides, 0) as n_slides, coalesce(n_blocks, 0)::bigint as n_blocks, coalesce(n_assets, 0) as n_assets, coalesce(bytes, 0)::bigint as bytes from dd left join s using (deck_id) left join a using (deck_id)""",
    "late_deliveries": """with x as (select scored_at, min(loaded_at) as l from submissions group by ps_id, submission_id, scored_at)
 select case when l < scored_at then 'before' when date_diff('day', scored_at, l) <= 1 then 'in time' when date_diff('day', scored_at, l) <= 7 then 'within a week' else 'late' end as kind, count(*) as n from x group by 1""",
    "event_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": """with a as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events), b as (select user_id, ts, sum(case when gap is null or gap >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from a)
 select user_id, min(ts) as session_start, count(*) as n from b group by user_id, s""",
    "deck_flow": f"""with {_SL2} select deck_id, bool_or(flow_present) as flow_present, arg_min(flow_direction, slide_number) filter (flow_direction <> 'unknown') as direction, count(*) filter (flow_direction <> 'unknown') as n_known from sf group by deck_id""",
    "merged_visibility": f"""with {_SLIDES}, a as (select deck_id, [visibility.native, visibility.rendered, visibility.ocr, visibility.vision] as v, list_filter([visibility.native, visibility.rendered, visibility.ocr, visibility.vision], lambda x: x not in ('not_requested', 'not_applicable')) as q from sd),
 b as (select deck_id, case when len(q) = 0 then case when list_contains(v, 'not_requested') then 'not_requested' else 'not_applicable' end when len(list_filter(q, lambda x: x = 'verified')) = len(q) then 'verified' when list_contains(q, 'verified') or list_contains(q, 'partial') then 'partial' when list_contains(q, 'failed') then 'failed' else 'unverified' end as status from a)
 select status, count(*) as n_slides, count(distinct deck_id) as n_decks from b group by status""",
    "stage_statuses": f"""with {_SLIDES}, a as (select unnest([{{'stage': 'native', 'status': visibility.native}}, {{'stage': 'rendered', 'status': visibility.rendered}}, {{'stage': 'ocr', 'status': visibility.ocr}}, {{'stage': 'vision', 'status': visibility.vision}}], recursive := true) from sd) select stage, status, count(*) as n from a group by stage, status""",
    "positional_words": f"""with {_NEXT}, wa as (select slide_key, unnest(regexp_extract_all(lower(t), '{_WORD}')) as w, generate_subscripts(regexp_extract_all(lower(t), '{_WORD}'), 1) as n from nx), wb as (select slide_key, unnest(regexp_extract_all(lower(u), '{_WORD}')) as w, generate_subscripts(regexp_extract_all(lower(u), '{_WORD}'), 1) as n from nx),
 a as (select *, row_number() over (partition by slide_key, w order by n) as k from wa), b as (select *, row_number() over (partition by slide_key, w order by n) as k from wb)
 select slide_key, count(*) as n_matched, sum(abs(a.n - b.n))::bigint as shift from a join b using (slide_key, w, k) group by slide_key""",
    "statement_recall": f"""with {_BLOCKS}, {_DECKS}, {_PROBLEMS}, k as (select deck_id, {_PID} as k from dd), p as (select {_PID} as k, unnest(requirements).description as r from pd),
 e as (select deck_id, replace(lower({_SQUEEZE.format('r')}), 'ß', 'ss') as r from k join p using (k) where r is not null and {_SQUEEZE.format('r')} <> ''), t as (select deck_id, string_agg(replace(lower(text), 'ß', 'ss'), chr(10)) as t from blocks group by deck_id),
 g as (select deck_id, count(*) as n, count(*) filter (contains(t, r)) as f from e left join t using (deck_id) group by deck_id), al as (select deck_id from t union select deck_id from e)
 select deck_id, coalesce(n, 0) as n_expected, coalesce(f, 0) as n_found, round(case when coalesce(n, 0) = 0 then 1.0 else f / n end, 6) as recall from al left join g using (deck_id)""",
    "slide_labels": f"""with {_SLIDES} select distinct deck_id, slide_number as page, case when slide_number >= 3 then 'p' || (slide_number - 2) when slide_number >= 1 then repeat('i', slide_number) else slide_number::varchar end as label from sd""",
    "selected_slides": f"""with {_SLIDES}, x as (select distinct deck_id, slide_number from sd), w as (select distinct deck_id, unnest([1, 2, 5]) as n from x), j as (select w.deck_id, x.slide_number as s from w left join x on x.deck_id = w.deck_id and x.slide_number = w.n) select deck_id, count(s) as n_there, count(*) - count(s) as n_missing from j group by deck_id""",
    "format_mismatch": f"""with {_DECKS}, x as (select lower(source_format) as source_format, lower(regexp_extract(deck_name, '\\.([A-Za-z0-9]+)$', 1)) as suffix from dd) select source_format, source_format = suffix as same, count(*) as n from x group by 1, 2""",
    "findings": f"""with {_LATEST}, l as (select ps_id || '/' || submission_id as submission, unnest([{{'name': 'final_score', 'v': final_score}}, {{'name': 'proposal_score', 'v': proposal_score}}, {{'name': 'deck_quality_score', 'v': deck_quality_score}}], recursive := true) from fin),
 k as (select submission, name, case when v is null then 'ambiguous' when v < 60 then 'weakness' when v >= 85 then 'strength' end as kind from l) select * from k where kind is not null""",
    "deck_metrics": f"with {_METRICS} select * from mt",
    "deck_scores": f"with {_SCORES} select *, case when final_score is not null then round(0.7 * 0.8 + 0.3 * deck_confidence, 6) end as final_confidence, case when final_score is null then 'REVIEW' else 'SCORED' end as status from fs",
}
