"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from .views import duck_with

ORACLES: dict[str, str] = {}


def R(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5e0) / 1e6)"


def add(name: str, views: list[str], body: str, more: str = "") -> None:
    with_ = ",\n".join(x for x in (duck_with(*views), more) if x)
    ORACLES[name] = (f"with {with_}\n" if with_ else "") + body


PAIRS = """pairs as (select a.recording_id, a.seg_id as a, b.seg_id as b, greatest(a.start_s, b.start_s) as start_s, least(a.end_s, b.end_s) as end_s
  from v_seg a join v_seg b on a.recording_id = b.recording_id and a.seg_id < b.seg_id and a.speaker <> b.speaker and a.end_s > b.start_s and a.start_s < b.end_s
  where least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) >= 0.08e0)"""


def merged(source: str, out: str, tol: str = "0.02e0") -> str:
    return f"""{out}_f as (select *, case when start_s <= max(end_s) over (partition by recording_id order by start_s, end_s rows between unbounded preceding and 1 preceding) + {tol} then 0 else 1 end as f from {source}),
{out}_g as (select *, sum(f) over (partition by recording_id order by start_s, end_s rows unbounded preceding) as g from {out}_f),
{out} as (select recording_id, min(start_s) as start_s, max(end_s) as end_s from {out}_g group by recording_id, g)"""


ISL = PAIRS + ",\n" + merged("pairs", "isl")
DUR = "dur as (select recording_id, max(end_s) as duration from v_seg group by 1)"


def split(source: str, out: str, keep: str, most: float, ov: float = 0.18) -> str:
    return f"""{out}_k as (select *, case when end_s - start_s <= {most}e0 + 1e-6 then 0 else cast(ceil((end_s - start_s - {most}e0 - 1e-6) / ({most}e0 - {ov}e0)) as int) end as k from {source} where end_s > start_s),
{out}_t as (select *, k > 0 and end_s - start_s - k * ({most}e0 - {ov}e0) < 0.8e0 as tail, unnest(range(0, k + 1)) as part from {out}_k),
{out}_p as (select *, case when part = k and tail then end_s - 0.8e0 else start_s + part * ({most}e0 - {ov}e0) end as s,
  case when part = k then end_s when tail and part = k - 1 then end_s - 0.8e0 + {ov}e0 else start_s + part * ({most}e0 - {ov}e0) + {most}e0 end as e from {out}_t),
{out} as (select {keep}, cast(part as int) as part, {R("s")} as start_s, {R("e")} as end_s from {out}_p where part < k or e - s >= 0.05e0)"""


add("overlap_pairs", ["v_seg"], f"select recording_id, a, b, {R('start_s')} as start_s, {R('end_s')} as end_s from pairs", PAIRS)
add("overlap_islands", ["v_seg"], f"select recording_id, {R('start_s')} as start_s, {R('end_s')} as end_s from isl", ISL)
add("overlap_seconds_by_recording", ["v_seg"], "select recording_id, count(*) as n, round(sum(end_s - start_s), 3) as seconds from isl group by 1", ISL)
add("strict_split", ["v_seg"], "select * from sp", split("v_seg", "sp", "recording_id, seg_id", 6.0))
add("strict_split_counts", ["v_seg"], "select recording_id, count(*) as pieces, round(sum(end_s - start_s), 3) as seconds from sp group by 1", split("v_seg", "sp", "recording_id, seg_id", 3.0))
CHUNKS = DUR + f""",
chunks as (select recording_id, cast(i as int) as idx, {R("greatest(0e0, i * 120e0 - 5e0)")} as start_s, {R("least(duration, least(duration, i * 120e0 + 120e0) + 5e0)")} as end_s,
  {R("i * 120e0")} as core_start, {R("least(duration, i * 120e0 + 120e0)")} as core_end from (select *, unnest(range(0, cast(ceil(duration / 120e0) as int))) as i from dur where duration > 0))"""
add("halo_chunks", ["v_seg"], "select * from chunks", CHUNKS)
add("halo_clip", ["v_seg"], f"""select t.recording_id, t.seg_id, c.idx, c.idx || ':' || t.speaker as speaker, {R("greatest(t.start_s, c.core_start)")} as start_s, {R("least(t.end_s, c.core_end)")} as end_s
from v_seg t join chunks c on t.recording_id = c.recording_id and t.end_s > c.core_start and t.start_s < c.core_end where least(t.end_s, c.core_end) - greatest(t.start_s, c.core_start) >= 0.01e0""", CHUNKS)  # fmt: skip
WINS = ISL + ",\n" + DUR + """,
iv as (select i.recording_id, duration, greatest(0e0, least(duration, start_s)) as start_s, greatest(0e0, least(duration, end_s)) as end_s from isl i join dur using (recording_id)
  where greatest(0e0, least(duration, end_s)) - greatest(0e0, least(duration, start_s)) >= 0.12e0),
""" + merged("iv", "grp", "0.35e0") + f""",
tiles as (select recording_id, duration, start_s + t * 8e0 as c0, least(end_s, start_s + t * 8e0 + 8e0) as c1 from
  (select grp.*, duration, unnest(range(0, cast(ceil((end_s - start_s - 1e-6) / 8e0) as int))) as t from grp join dur using (recording_id) where end_s - start_s > 1e-6)),
cov as (select t.recording_id, t.duration, c0, c1, count(*) as n_pieces, round(sum({R("least(i.end_s, c1)")} - {R("greatest(i.start_s, c0)")}), 3) as covered
  from tiles t join iv i on t.recording_id = i.recording_id and least(i.end_s, c1) - greatest(i.start_s, c0) >= 0.12e0 group by 1, 2, 3, 4),
win as (select recording_id, row_number() over (partition by recording_id order by c0) - 1 as idx, {R("greatest(0e0, c0 - 1e0)")} as start_s, {R("least(duration, c1 + 1e0)")} as end_s,
  {R("c0")} as overlap_start, {R("c1")} as overlap_end, n_pieces, covered from cov)"""  # fmt: skip
add("separation_windows", ["v_seg"], "select * from win", WINS)
add("anchor_pieces_top2", ["v_seg"], f"""select recording_id, idx, speaker, rank, {R("start_s")} as start_s, {R("start_s + least(3e0, end_s - start_s)")} as end_s from ranked where rank <= 2""", WINS + f""",
holes as (select t.recording_id, t.seg_id, t.start_s as t0, t.end_s as t1, i.start_s as h0, i.end_s as h1 from v_seg t join isl i on t.recording_id = i.recording_id and t.end_s > i.start_s and t.start_s < i.end_s),
cut as (select recording_id, seg_id, coalesce(lag(h1) over w, t0) as start_s, h0 as end_s from holes window w as (partition by recording_id, seg_id order by h0)
  union all select recording_id, seg_id, max(h1), max(t1) from holes group by 1, 2
  union all select recording_id, seg_id, start_s, end_s from v_seg t where not exists (select 1 from holes h where h.recording_id = t.recording_id and h.seg_id = t.seg_id)),
pieces as (select * from cut where end_s - start_s >= 0.6e0),
act as (select distinct w.recording_id, w.idx, t.speaker from win w join v_seg t on w.recording_id = t.recording_id and t.end_s > w.overlap_start and t.start_s < w.overlap_end),
near as (select w.recording_id, w.idx, w.start_s as w0, w.end_s as w1, t.seg_id, t.speaker from win w join v_seg t on w.recording_id = t.recording_id and t.end_s >= w.start_s - 6e0 and t.start_s <= w.end_s + 6e0
  join act a on a.recording_id = w.recording_id and a.idx = w.idx and a.speaker = t.speaker),
ranked as (select n.recording_id, n.idx, n.speaker, p.start_s, p.end_s, cast(row_number() over (partition by n.recording_id, n.idx, n.speaker
  order by {R("least(abs(p.end_s - w0), abs(p.start_s - w1))")}, {R("p.start_s - p.end_s")}, p.seg_id, p.start_s) as int) as rank from near n join pieces p on n.recording_id = p.recording_id and n.seg_id = p.seg_id)""")  # fmt: skip
add("select_range", ["v_seg"], f"select recording_id, speaker, seg_id, kind, {R('start_s')} as start_s, {R('end_s')} as end_s from v_seg where end_s > 3600 and start_s < 7200")
add("shift_range", ["v_seg"], f"select recording_id, speaker, seg_id, kind, {R('greatest(0e0, start_s - 40000e0)')} as start_s, {R('greatest(0e0, end_s - 40000e0)')} as end_s from v_seg")
add("decode_window", [], f"""select event_id, {R("b0")} as decode_start, {R("s - b0 + d + c")} as decode_duration, {R("s - b0")} as selection_start, {R("s - b0 + d")} as selection_end from
(select *, greatest(0e0, s - c) as b0 from (select event_id, greatest(0e0, value - 50) as s, least(180e0, greatest(10e0, value)) as d, least(3e0, event_id % 5) as c from events))""")
NORM = "regexp_replace(lower({0}), '[\\s\\p{{P}}\\p{{Z}}]+', '', 'g')"
norm = NORM.format
add("clean_utterances", ["v_utt"], f"""select recording_id, turn, speaker, {R("start_s + 0.12e0")} as start_s, {R("end_s - 0.12e0")} as end_s from v_utt a
where {R("end_s - start_s - 2 * 0.12e0")} between 0.8e0 and 6e0 and trim(speaker) <> '' and length({norm("text")}) >= 3 and not exists (
  select 1 from v_utt b where b.recording_id = a.recording_id and b.speaker <> a.speaker and trim(b.speaker) <> '' and b.end_s > b.start_s and b.end_s > a.start_s and b.start_s < a.end_s)""")
add("speaker_argmax_overlap", ["v_seg"], f"""select recording_id, seg_id, best_id, overlap_s from (select a.recording_id, a.seg_id, b.seg_id as best_id, {R("least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)")} as overlap_s,
  row_number() over (partition by a.recording_id, a.seg_id order by {R("least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)")} desc, {R("abs(a.start_s + a.end_s - b.start_s - b.end_s) / 2")}, b.seg_id) as n
  from v_seg a join v_seg b on a.recording_id = b.recording_id and a.speaker % 2 = 0 and b.speaker % 2 = 1 and a.end_s > b.start_s and a.start_s < b.end_s) where n = 1""")
add("tune_speaker_scores", ["v_seg"], """select a.recording_id, a.speaker as cluster, b.speaker as label, round(sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)), 3) as score
from v_seg a join v_seg b on a.recording_id = b.recording_id and a.speaker < 2 and b.speaker >= 2 and a.end_s > b.start_s and a.start_s < b.end_s group by 1, 2, 3""")
add("boundary_iou", ["v_seg"], f"""select v.recording_id, v.seg_id, {R("coalesce(iou, 0e0)")} as iou from v_seg v left join (select a.recording_id, a.seg_id,
  max((least(a.end_s, b.e) - greatest(a.start_s, b.s)) / (greatest(a.end_s, b.e) - least(a.start_s, b.s))) as iou from v_seg a join
  (select recording_id, start_s + 1.5e0 as s, end_s + 1.5e0 as e from v_seg) b on a.recording_id = b.recording_id and a.end_s > b.s and a.start_s < b.e group by 1, 2) j using (recording_id, seg_id)""")
add("islands_union_manual", ["v_seg"], f"select recording_id, {R('start_s')} as start_s, {R('end_s')} as end_s from m", ISL + ",\nboth_ as (select recording_id, start_s, end_s from isl union all select recording_id, start_s, end_s from v_seg where kind = 'error'),\n" + merged("both_", "m"))
BASE = split("v_seg", "sp", "recording_id, seg_id", 6.0) + ",\nbase as (select *, row_number() over (partition by recording_id order by seg_id, part) - 1 as group_no from sp)"
add("recognition_items", ["v_seg"], "select recording_id, group_no, seg_id, part, start_s, end_s from base", BASE)
REP = ISL + ",\n" + BASE + f""",
hit as (select b.recording_id, b.group_no, b.start_s as g0, b.end_s as g1, i.start_s, i.end_s from base b join isl i on b.recording_id = i.recording_id and b.end_s > i.start_s and b.start_s < i.end_s),
span as (select distinct h.recording_id, h.group_no, g0, g1, t.speaker, greatest(g0, t.start_s) as start_s, least(g1, t.end_s) as end_s from hit h join v_seg t on h.recording_id = t.recording_id
  and t.end_s > h.start_s and t.start_s < h.end_s and t.end_s > g0 and t.start_s < g1),
rep1 as (select recording_id, group_no, speaker, min(start_s) as start_s, min(end_s) as end_s from span where {R("end_s - start_s")} >= 0.45e0 and greatest({R("start_s - g0")}, {R("g1 - end_s")}) >= 0.12e0
  group by recording_id, group_no, speaker, floor(start_s * 1000 + 0.5e0), floor(end_s * 1000 + 0.5e0)),
""" + split("rep1", "rep", "recording_id, group_no, speaker", 6.0)  # fmt: skip
add("repair_spans", ["v_seg"], "select * from rep", REP)
VAR = REP + f""",
vg as (select r.*, i * 3 + j as v, start_s + a as v0, end_s - b as v1 from rep r, (values (0, 0e0), (1, 0.08e0), (2, 0.16e0)) s(i, a), (values (0, 0e0), (1, 0.5e0), (2, 0.75e0)) e(j, b)),
vv as (select *, row_number() over (partition by recording_id, group_no, speaker, start_s, end_s order by v) - 1 as i, count(*) over (partition by recording_id, group_no, speaker, start_s, end_s) as n
  from vg where {R("v1 - v0")} >= 0.45e0),
va as (select recording_id, {R("v0")} as start_s, {R("v1")} as end_s, case when i = 0 or i = n - 1 or i = (n - 1) // 2 then 'primary' else 'extended' end as tier from vv)"""
add("repair_variants", ["v_seg"], "select recording_id, tier, count(*) as n, round(sum(end_s - start_s), 2) as seconds from va group by 1, 2", VAR)
add("recognition_dedup", ["v_seg"], "select recording_id, count(*) as distinct_items from (select distinct recording_id, floor(start_s * 1000 + 0.5e0) as a, floor(end_s * 1000 + 0.5e0) as b from va) group by 1", VAR)


def vote(source: str, key: str) -> str:
    on = " and ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    by = ", ".join(f"a.{k}" for k in key.split(", "))
    return f"""u as (select {key}, ord, trim(text) as text from {source} where trim(text) <> ''),
s as (select {by}, a.ord, a.text, round(sum(1 - levenshtein(a.text, b.text) / greatest(1, length(a.text), length(b.text))::double) / count(*), 9) as consensus, cast(sum(case when a.text = b.text then 1 else 0 end) as int) as votes
  from u a join u b on {on} group by {by}, a.ord, a.text),
won as (select * exclude (n) from (select *, row_number() over (partition by {key} order by consensus desc, votes desc, length(text) desc, ord) as n from s) where n = 1)"""


add("consensus_vote", ["v_cand"], f"select group_id, ord, text, {R('consensus')} as consensus, votes from won", vote("v_cand", "group_id"))
add("expansion_needed", ["v_cand"], "select group_id from (select distinct group_id from v_cand) left join won using (group_id) where consensus is null or consensus < 0.55e0 or votes < 2", vote("v_cand", "group_id"))
# each pair of candidates is measured once; with itself a candidate agrees
add("finalize_groups", ["v_cand"], """select group_id, repair_id, text, true as recovered from ok union all
select c.group_id, null, trim(c.text), false from v_cand c left join (select distinct group_id from ok) k on k.group_id = c.group_id where c.ord = 3 and trim(c.text) <> '' and k.group_id is null""", """u as (select group_id, ord % 2 as repair_id, ord, trim(text) as text from v_cand where trim(text) <> ''),
p as (select a.group_id, a.ord as i, b.ord as j, 1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text))::double as sim, case when a.text = b.text then 1 else 0 end as eq
  from u a join u b on a.group_id = b.group_id and a.repair_id = b.repair_id and a.ord < b.ord),
q as (select group_id, i as ord, sim, eq from p union all select group_id, j, sim, eq from p union all select group_id, ord, 1e0, 1 from u),
r as (select group_id, ord, round(sum(sim) / count(*), 9) as consensus, sum(eq) as votes from q group by 1, 2),
won as (select * from (select u.*, consensus, row_number() over (partition by u.group_id, u.repair_id order by consensus desc, votes desc, length(text) desc, u.ord) as n from u join r on r.group_id = u.group_id and r.ord = u.ord) where n = 1),
w as (select group_id, repair_id, (group_id + repair_id) % 3 as speaker, consensus, 0.4e0 + (group_id % 7) * 0.2e0 * (repair_id + 0.5e0) as span_s, text from won),
cv as (select group_id, speaker, sum(span_s) as cover from w group by 1, 2),
cm as (select group_id, max(cover) as most from cv group by 1),
cn as (select group_id, count(*) as n from w group by 1),
ok as (select w.group_id, w.repair_id, w.text from w join cv on cv.group_id = w.group_id and cv.speaker = w.speaker join cm on cm.group_id = w.group_id join cn on cn.group_id = w.group_id
  where consensus >= 0.34e0 and span_s >= 0.45e0 and (n = 1 or cover >= most * 0.45e0))""")  # fmt: skip
add("reject_reason_histogram", ["v_gate"], """select case when event_id % 97 = 0 then 'missing-metrics' when share < 0.008e0 then 'silent-stem' when abs(corr) > 0.97e0 then 'correlated-stems' when no_text then 'missing-stem-transcript'
when emb_dist < 0.08e0 then 'same-speaker-embedding' when no_anchor then 'missing-baseline-anchor' else 'accepted' end as reason, count(*) as n from v_gate group by 1""")
add("normalize_text", [], f"select doc_id, {norm('coalesce(text, chr(32))')} as normalized from documents")
add("text_weight", [], "select conv_id, turn, greatest(1, length(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]', '', 'g'))) as weight from conversations")


def nv(view: str, *cols: str) -> str:
    return f"np as (select * replace ({', '.join(f'{norm(c)} as {c}' for c in cols)}) from {view})"


def tsim(a: str, b: str) -> str:
    return f"""(case when length({a}) = 0 or length({b}) = 0 then 0e0 when contains({a}, {b}) or contains({b}, {a}) then least(length({a}), length({b})) / greatest(length({a}), length({b}))::double
  else 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double end)"""


def asim(a: str, b: str) -> str:
    return f"(case when least(length({a}), length({b})) >= 4 and (contains({a}, {b}) or contains({b}, {a})) then 1e0 else {tsim(a, b)} end)"


add("edit_distance", ["v_pair"], f"select utt_id, levenshtein(ref, hyp) as distance, {R('1 - levenshtein(ref, hyp) / greatest(1, length(ref), length(hyp))::double')} as similarity from np", nv("v_pair", "ref", "hyp"))
add("text_similarity", ["v_pair2"], f"select utt_id, {R(tsim('r1', 'h1'))} as similarity, {R(tsim('r1', 'substr(r1, 3, 40)'))} as contained from np", nv("v_pair2", "r1", "h1"))
add("anchor_similarity", ["v_pair2"], f"select utt_id, {R(asim('r1', 'h1'))} as anchor, {R(asim('r1', 'substr(r1, 5, 3)'))} as short from np", nv("v_pair2", "r1", "h1"))
COV = nv("v_pair", "ref", "hyp") + """,
rc as (select utt_id, c, count(*) as r from (select utt_id, unnest(string_split(ref, '')) as c from np) where c <> '' group by 1, 2),
hc as (select utt_id, c, count(*) as h from (select utt_id, unnest(string_split(hyp, '')) as c from np) where c <> '' group by 1, 2),
cov as (select np.utt_id, np.source, length(ref) as reference_chars, length(hyp) as hypothesis_chars, coalesce(m, 0) as matched from np
  left join (select utt_id, cast(sum(least(r, h)) as bigint) as m from rc join hc using (utt_id, c) group by 1) x using (utt_id))"""
RATES = f"""omissions, additions, {R("p")} as precision, {R("r")} as recall, {R("case when p + r > 0 then 2 * p * r / (p + r) else 0e0 end")} as f1 from
(select *, reference_chars - matched as omissions, hypothesis_chars - matched as additions, matched / greatest(1, hypothesis_chars)::double as p, matched / greatest(1, reference_chars)::double as r from"""
add("char_coverage", ["v_pair"], f"select utt_id, reference_chars, hypothesis_chars, matched, {RATES} cov)", COV)
add("char_coverage_micro", ["v_pair"], f"""select source, reference_chars, hypothesis_chars, matched, {RATES} (select source, cast(sum(reference_chars) as bigint) as reference_chars, cast(sum(hypothesis_chars) as bigint) as hypothesis_chars,
  cast(sum(matched) as bigint) as matched from cov group by 1))""", COV)
N4 = nv("v_pair2", "r1", "r2", "h1", "h2")
add("pit_cer_2spk", ["v_pair2"], f"""select utt_id, least(s, x) as distance, x < s as swapped, {R("least(s, x) / greatest(1, length(r1) + length(r2))::double")} as cer
from (select *, levenshtein(r1, h1) + levenshtein(r2, h2) as s, levenshtein(r1, h2) + levenshtein(r2, h1) as x from np)""", N4)
add("cp_cer_2spk", ["v_pair2"], f"""select utt_id, d as distance, {R("d / greatest(1, length(r1) + length(r2))::double")} as cer from (select *, least(levenshtein(r1 || r2, h1 || h2), levenshtein(r2 || r1, h1 || h2)) as d from np)""", N4)
PARSED = r"""ln as (select recording_id, turn, trim(line) as v from v_lines where trim(line) <> ''),
mt as (select *, regexp_matches(v, '^\[([^\]]+?)\s*-->\s*([^\]]+?)\]\s*(.+)$') as m, regexp_extract(v, '^\[([^\]]+?)\s*-->\s*([^\]]+?)\]\s*(.+)$', 1) as a,
  regexp_extract(v, '^\[([^\]]+?)\s*-->\s*([^\]]+?)\]\s*(.+)$', 2) as b, trim(regexp_extract(v, '^\[([^\]]+?)\s*-->\s*([^\]]+?)\]\s*(.+)$', 3)) as body from ln),
tm as (select *, case when m then cast(string_split(a, ':')[1] as double) * 3600 + cast(string_split(a, ':')[2] as double) * 60 + cast(string_split(a, ':')[3] as double) end as start_s,
  case when m then cast(string_split(b, ':')[1] as double) * 3600 + cast(string_split(b, ':')[2] as double) * 60 + cast(string_split(b, ':')[3] as double) end as end_s,
  regexp_matches(body, '^([^:：]{1,80})[:：]\s*(.+)$') as sp, trim(regexp_extract(body, '^([^:：]{1,80})[:：]\s*(.+)$', 1)) as speaker, trim(regexp_extract(body, '^([^:：]{1,80})[:：]\s*(.+)$', 2)) as text from mt),
""" + f"""pw as (select *, case when not m then 'no-time' when end_s <= start_s then 'bad-time' when not sp then 'no-speaker' when {norm("text")} = '' then 'empty-text' end as warning from tm)"""
add("parse_timed_transcript", ["v_lines"], "select recording_id, turn, start_s, end_s, speaker, text from pw where warning is null", PARSED)
add("transcript_warnings", ["v_lines"], "select recording_id, turn, warning from pw where warning is not null", PARSED)
CASES = f"""sg as (select recording_id, turn as seg_id, speaker, start_s, end_s, trim(text) as text from v_utt where trim(speaker) <> '' and {norm("text")} <> ''),
""" + PAIRS.replace("v_seg", "sg") + ",\n" + merged("pairs", "isl") + f""",
ac as (select i.recording_id, i.start_s as o0, i.end_s as o1, s.* exclude (recording_id) from isl i join sg s on i.recording_id = s.recording_id and s.end_s > i.start_s and s.start_s < i.end_s),
ag as (select recording_id, o0, o1, count(distinct speaker) as speakers, string_agg(cast(seg_id as varchar), '|' order by cast(seg_id as varchar)) as ids, min(start_s) as start_s, max(end_s) as end_s from ac group by 1, 2, 3),
said as (select recording_id, o0, string_agg(t, '/' order by speaker) as texts from (select recording_id, o0, speaker, string_agg(text, '' order by start_s, end_s) as t from ac group by 1, 2, 3) group by 1, 2),
cs as (select ag.recording_id, {R("ag.o0")} as overlap_start, {R("o1")} as overlap_end, {R("start_s")} as start_s, {R("end_s")} as end_s, texts,
  case when speakers <> 2 then 'not-exactly-two-speakers' when end_s - start_s > 25e0 + 1e-6 then 'case-too-long' end as reason
  from (select *, row_number() over (partition by recording_id, ids order by o0) as n from ag) ag join said on ag.recording_id = said.recording_id and ag.o0 = said.o0 where speakers <> 2 or n = 1)"""
add("overlap_cases", ["v_utt"], "select * exclude (reason) from cs where reason is null", CASES)
add("case_skips", ["v_utt"], "select reason, count(*) as n from cs where reason is not null group by 1", CASES)
add("manifest_validation", ["v_pair2"], f"""select recording_id, case_id, fault from (select recording_id, case_id, unnest([case when trim(recording_id) = '' then 'no-recording-id' end, case when audio is null then 'no-audio' end,
  case when trim(case_id) = '' then 'no-case-id' end, case when trim(case_id) <> '' and n > 1 then 'duplicate-case-id' end, case when utt_id % 19 = 0 then 'bad-times' end,
  case when utt_id % 11 = 0 or utt_id % 13 = 0 then 'not-two-speakers' end, case when utt_id % 17 = 0 or {norm("r1")} = '' or {norm("r2")} = '' then 'empty-reference' end]) as fault
  from (select *, row_number() over (partition by case_id order by recording_id, 0) as n from (select *, case when utt_id % 41 = 0 then '' else source end as recording_id, case when utt_id % 31 = 0 then null else 'a.wav' end as audio,
    case when utt_id % 29 = 0 then '' else 'c' || (utt_id - case when utt_id % 23 = 0 then 1 else 0 end) end as case_id from v_pair2))) where fault is not null""")
REPORT = f"""count(*) as cases, cast(sum(reference_chars) as bigint) as reference_chars, {R("sum(mixture_distance) / greatest(1, sum(reference_chars))::double")} as mixture_cer,
  {R("sum(separated_distance) / greatest(1, sum(reference_chars))::double")} as separated_cer, {R("(sum(mixture_distance) - sum(separated_distance)) / greatest(1, sum(reference_chars))::double")} as cer_delta,
  count(*) filter (gate_accepted) as gate_accepted, {R("count(*) filter (gate_accepted) / greatest(1, count(*))::double")} as gate_rate, {R("sum(duration_s)")} as audio_s,
  {R("sum(separation_ms) / 1000e0 / greatest(0.001e0, sum(duration_s))")} as separation_rtf"""
add("report_grouping_sets", ["v_cases"], f"select dataset, snr_db, overlap_ratio, {REPORT}, cast(grouping(dataset, overlap_ratio, snr_db) as int) as level from v_cases group by grouping sets ((), (dataset), (snr_db, overlap_ratio))")
add("case_summary", ["v_cases"], f"select {REPORT} from v_cases")
add("merge_same_speaker", ["v_utt"], f"""select recording_id, cast(run as int) as run, first(spk) as spk, {R("arg_min(start_s, turn)")} as start_s, {R("arg_max(end_s, turn)")} as end_s,
  string_agg(case when text = '' then '' when last_ then text when ends_with(text, '。') then text else text || '。' end, '' order by turn) as text
from (select *, not exists (select 1 from r1 b where b.recording_id = a.recording_id and b.run = a.run and b.turn > a.turn and b.text <> '') as last_ from r1 a) group by recording_id, run""", """r0 as (select *, case when spk >= 0 and lag(spk) over (partition by recording_id order by turn) = spk then 0 else 1 end as f from v_utt),
r1 as (select *, sum(f) over (partition by recording_id order by turn rows unbounded preceding) as run from r0)""")  # fmt: skip


def clock(x: str) -> str:
    f = f"cast(floor(greatest(0e0, {x})) as bigint)"
    return f"printf('%02d:%02d:%02d', {f} // 3600, ({f} // 60) % 60, {f} % 60)"


def stamp(x: str, sep: str) -> str:
    return f"({clock(x)} || '{sep}' || printf('%03d', cast(floor((greatest(0e0, {x}) % 1) * 1000) as bigint)))"


NAME = "(case when spk is null then '' when spk < 0 then '話者不明' else '話者' || (spk + 1) end)"
PRE = f"(case when spk is null then '' else {NAME} || ': ' end)"
NL = "chr(10)"
add("export_txt", ["v_utt"], f"select recording_id, string_agg('[' || {clock('start_s')} || ' --> ' || {clock('end_s')} || '] ' || {PRE} || text, {NL} order by turn) as content from v_utt group by 1")
add("export_srt", ["v_utt"], f"select recording_id, string_agg(n || {NL} || {stamp('start_s', ',')} || ' --> ' || {stamp('end_s', ',')} || {NL} || {PRE} || text || {NL}, {NL} order by turn) as content from (select *, row_number() over (partition by recording_id order by turn) as n from v_utt) group by 1")
add("export_vtt", ["v_utt"], f"select recording_id, 'WEBVTT' || {NL} || {NL} || string_agg({stamp('start_s', '.')} || ' --> ' || {stamp('end_s', '.')} || {NL} || {PRE} || text || {NL}, {NL} order by turn) as content from v_utt group by 1")
BLK = "select recording_id, 'b' || (seg_id % 997) as id, start_s as block_start, end_s as block_end, case when seg_id % 2 = 0 then start_s end as source_start, case when seg_id % 2 = 0 then end_s end as source_end from v_seg where"
add("correction_upsert", ["v_seg"], f"""select recording_id, id, {", ".join(f"{R(c)} as {c}" for c in ("block_start", "block_end", "source_start", "source_end"))} from (select * from old o where not exists (select 1 from new n where n.recording_id = o.recording_id
  and (n.id = o.id or (coalesce(o.source_end, o.block_end) > coalesce(n.source_start, n.block_start) and coalesce(o.source_start, o.block_start) < coalesce(n.source_end, n.block_end)))) union all select * from new)""",
    f"old as ({BLK} kind <> 'error'),\nnew as ({BLK} kind = 'error')")
add("apply_whole_range", ["v_seg"], f"""select recording_id, {R("start_s")} as start_s, {R("end_s")} as end_s, 't' || seg_id as text, false as locked, null as correction_id, null as correction_ord from v_seg s
where not exists (select 1 from v_seg b where b.kind = 'error' and b.recording_id = s.recording_id and greatest(s.end_s, s.start_s + 0.001e0) > b.start_s and s.start_s < b.end_s)
union all select recording_id, {R("start_s")}, {R("end_s")}, 'fixed', true, cast(seg_id as varchar), 1 from v_seg where kind = 'error'""")
add("interpolate_times", ["v_utt"], f"""select recording_id, ord, {R("case when t then s else ga + room * (upto - w) / tot end")} as start_s,
  {R("case when t then e else greatest(ga + room * (upto - w) / tot + 0.001e0, case when i = n then gb else ga + room * upto / tot end) end")} as end_s from x5""", """x0 as (select recording_id, turn as ord, speaker = 'user' and end_s > start_s as t, start_s, end_s, greatest(1, length(regexp_replace(text, '[\\s\\p{Z}]', '', 'g'))) as w,
  min(start_s) over p as a, max(end_s) over p as b from v_utt window p as (partition by recording_id)),
x1 as (select *, case when t then greatest(a, least(greatest(a, b - 0.001e0), start_s)) end as s from x0),
x2 as (select *, case when t then least(b, greatest(least(b, s + 0.001e0), end_s)) end as e from x1),
x3 as (select *, coalesce(last_value(e ignore nulls) over (partition by recording_id order by ord rows between unbounded preceding and 1 preceding), a) as pa,
  coalesce(first_value(s ignore nulls) over (partition by recording_id order by ord rows between 1 following and unbounded following), b) as pb,
  sum(case when t then 1 else 0 end) over (partition by recording_id order by ord rows unbounded preceding) as run from x2),
x4 as (select *, sum(w) over q as tot, count(*) over q as n, sum(w) over (partition by recording_id, run, t order by ord rows unbounded preceding) as upto, row_number() over (partition by recording_id, run, t order by ord) as i,
  case when pb > pa then pa else greatest(a, least(greatest(a, b - 0.001e0), pa)) end as ga from x3 window q as (partition by recording_id, run, t)),
x5 as (select *, gb, greatest(0.001e0 * n, gb - ga) as room from (select *, case when pb > pa then pb else least(b, ga + 0.001e0 * n) end as gb from x4))""")  # fmt: skip
add("speaker_seeds", ["v_utt"], "select recording_id, speaker as correction_speaker_key, cast(row_number() over (partition by recording_id order by f) - 1 as int) as speaker from (select recording_id, speaker, min(turn) as f from v_utt group by 1, 2)")
VEC = """vd as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
vn as (select vec_id, label, v, list_transform(v, lambda x: x / (case when sqrt(list_inner_product(v, v)) = 0 then 1 else sqrt(list_inner_product(v, v)) end)) as u from vd)"""


def cents(where: str) -> str:
    return f"""ce as (select label, i, avg(x) as x from (select label, unnest(u) as x, unnest(range(1, len(u) + 1)) as i from (select *, row_number() over (partition by label order by vec_id) as n from vn) where {where}) group by 1, 2),
cl as (select label, list(x order by i) as c from ce group by 1),
cn as (select label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from cl)"""


add("l2_normalize", [], f"select vec_id, {R('u[1]')} as first, {R('list_inner_product(u, u)')} as norm, {R('list_inner_product(u, list_reverse(u))')} as mirror from vn", VEC)
add("speaker_centroids", [], f"select label, {R('c[1]')} as first, {R('c[64]')} as last, cast(len(c) as int) as dims from cn", VEC + ",\n" + cents("true"))
ASSIGN = VEC + ",\n" + cents("n <= 3") + """,
dd as (select vec_id, vn.label, cn.label as k, round(1 - list_inner_product(u, cn.c), 9) as d from vn, cn),
asg as (select vec_id, k as assigned, d from (select *, row_number() over (partition by vec_id order by d, k) as n from dd) where n = 1)"""
add("assign_by_references", [], f"select vec_id, assigned, {R('d')} as distance from asg", ASSIGN)
add("reassign_pinned", [], """select vec_id, coalesce(p.label, case when d > 0.75e0 then -1 else assigned end) as assigned from asg left join
(select vec_id, label from (select *, row_number() over (partition by label order by vec_id) as n from vn) where n <= 3) p using (vec_id)""", ASSIGN)
SURE = lambda d: R(f"greatest(0e0, least(1e0, 1 - {d})) * least(1e0, 0.5e0 + coalesce(s2 - s, 0e0) * 4)")
add("stem_pair_assign", [], f"""select id, k0 as speaker0, k1 as speaker1, {SURE("d0")} as confidence0, {SURE("d1")} as confidence1 from pr where n = 1 and d0 <= 0.8e0 and d1 <= 0.8e0""", ASSIGN + """,
pr as (select id, k0, k1, d0, d1, s, row_number() over w as n, lead(s) over w as s2 from (select a.vec_id as id, a.k as k0, b.k as k1, a.d as d0, b.d as d1, round(a.d + b.d, 9) as s from dd a join dd b on b.vec_id = a.vec_id + 1 and a.k <> b.k)
  window w as (partition by id order by s, k0, k1, d0, d1))""")  # fmt: skip
add("rms_correlation", [], f"""select vec_id, {R("sqrt(list_inner_product(v, v) / greatest(1, len(v)))")} as rms, {R("list_inner_product(v, list_reverse(v)) / greatest(1e-12, sqrt(list_inner_product(v, v) * list_inner_product(v, v)))")} as corr,
  {R("list_sum(v) / len(v)")} as mean from vd""", VEC)
add("blend", [], f"""select vec_id, cast(len(b) as int) as n, {R("list_sum(b)")} as total from (select vec_id, case when k <= 0 then v when k >= 1 then list_transform(e, lambda x: cast(x as double)) else
  list_transform(range(1, 51), lambda i: v[i] * (1 - k) + e[i] * k) end as b from (select vec_id, v, list_reverse(v)[1:50] as e, (vec_id % 5 - 1) / 3e0 as k from vd))""", VEC)
add("stem_scale", [], f"""select vec_id, {R("sqrt(list_inner_product(c, c) / len(c)) * sc")} as rms, {R("list_max(c) * sc")} as peak from (select *, least(1.15e0 * greatest(0.015e0, (vec_id % 10) / 50e0) / greatest(1e-12, sqrt(list_inner_product(c, c) / len(c))),
  0.95e0 / greatest(1e-12, list_max(list_transform(c, lambda x: abs(x))))) as sc from (select vec_id, list_transform(v, lambda x: x - list_sum(v) / len(v)) as c from vd))""", VEC)
add("waveform_peaks", [], f"select vec_id, cast((i - 1) // greatest(1, n // 7) as int) as bucket, {R('max(abs(x))')} as peak from (select vec_id, len(v) as n, unnest(v) as x, unnest(range(1, len(v) + 1)) as i from vd) group by 1, 2", VEC)
add("pcm16_samples", [], "select vec_id, cast(list_sum(p) as bigint) as total, list_max(p) as top from (select vec_id, list_transform(v, lambda x: cast(floor(greatest(-1e0, least(1e0, x)) * 32767 + 0.5e0) as int)) as p from vd)", VEC)
add("peak_hold", [], f"""select a.stream, a.chunk, {R("max(b.peak * pow(0.7e0, a.n - b.n))")} as held from pk a join pk b on a.stream = b.stream and b.n <= a.n group by 1, 2""",
    "pk as (select *, row_number() over (partition by stream order by chunk) as n from (select cast(event_id % 50 as int) as stream, cast(floor(event_id / 50) as bigint) as chunk, max(value) as peak from events group by 1, 2))")


def cl(x: str, a: float, b: float) -> str:
    return R(f"least({b}e0, greatest({a}e0, {x}))")


OPT = f"""op as (select event_id as job_id, {cl("(event_id % 7) / 5e0", 0.0, 1.0)} as denoise, {cl("value / 20", 3.0, 20.0)} as max_speech, {cl("value / 300", 0.05, 1.0)} as min_silence, {cl("value / 700", 0.05, 0.5)} as min_speech,
  {cl("value / 400", 0.1, 0.9)} as threshold, event_id % 2 = 0 as overlap, cast(greatest(2, least(4, event_id % 6)) as int) as speakers from events)"""
FLD = "denoise, max_speech, min_silence, min_speech, threshold, overlap, speakers"
PST = "ps as (select * from (values (0, 6e0, 0.2e0, 0.15e0, 0.5e0, false), (1, 3e0, 0.1e0, 0.2e0, 0.7e0, true), (2, 3e0, 0.1e0, 0.15e0, 0.2e0, true), (3, 8e0, 0.35e0, 0.15e0, 0.45e0, false)) t(p, max_speech, min_silence, min_speech, threshold, overlap))"


def dist(a: str, b: str) -> str:
    d = lambda c: f"abs({a}.{c} - {b}.{c})"
    return R(f"{d('denoise')} + {d('max_speech')} / 17 + {d('min_silence')} / 0.95e0 + {d('min_speech')} / 0.45e0 + {d('threshold')} / 0.8e0 + case when {a}.overlap = {b}.overlap then 0e0 else 0.5e0 end + {d('speakers')} * 0.1e0")


add("tuning_options", [], "select * from op", OPT)
add("recognition_options", [], f"""select event_id, case ps.p when 0 then 'standard' when 1 then 'conversation' when 2 then 'interview' when 3 then 'lecture' else 'other' end as preset,
  {cl("case when event_id % 3 <> 0 then value / 400 else coalesce(ps.threshold, 0.5e0) end", 0.1, 0.9)} as threshold, {cl("value / 300", 0.05, 2.0)} as min_silence, {cl("value / 700", 0.05, 1.0)} as min_speech, {cl("value / 20", 2.0, 30.0)} as max_speech
from events left join ps on ps.p = event_id % 5""", PST)
GRID = OPT + ",\n" + PST + f""",
cur as (select * replace (2 as speakers) from op),
al as (select job_id, -1 as p, 0 as k, {FLD} from cur union all
  select c.job_id, ps.p, k, case k when 0 then 0e0 when 1 then 0.8e0 else c.denoise end, ps.max_speech, ps.min_silence, ps.min_speech, ps.threshold, ps.overlap, 2 from cur c, ps, (values (0), (1), (2)) t(k)),
dd as (select *, row_number() over (partition by job_id, {FLD} order by p, k) as n from al),
gr as (select * from (select job_id, cast(row_number() over (partition by job_id order by p, k) as int) as candidate, {FLD} from dd where n = 1) where candidate <= 12)"""
add("coarse_grid", [], f"select g.*, {dist('g', 'c')} as seed_distance from gr g join cur c using (job_id)", GRID)
add("refine_grid", [], f"select r.job_id, cast(row_number() over (partition by r.job_id order by r.n) as int) as candidate, {', '.join('r.' + f.strip() for f in FLD.split(','))}, {dist('r', 's')} as seed_distance from rf r join gr s on s.job_id = r.job_id and s.candidate = 1", GRID + f""",
rv as (select g.job_id, t.n, denoise, {cl("max_speech + dm", 3.0, 20.0)} as max_speech, min_silence, min_speech, {cl("threshold + dt", 0.1, 0.9)} as threshold, overlap, speakers
  from gr g, (values (1, -0.15e0, 0e0), (2, 0.15e0, 0e0), (3, 0e0, -1e0), (4, 0e0, 2e0)) t(n, dt, dm) where g.candidate = g.job_id % 3 + 1),
rd as (select * from (select *, row_number() over (partition by job_id, {FLD} order by n) as f from rv) where f = 1),
rf as (select * exclude (f) from rd r where not exists (select 1 from gr g where g.job_id = r.job_id and g.denoise = r.denoise and g.max_speech = r.max_speech and g.min_silence = r.min_silence and g.min_speech = r.min_speech
  and g.threshold = r.threshold and g.overlap = r.overlap and g.speakers = r.speakers))""")  # fmt: skip
add("option_distance", [], f"select a.job_id, {dist('a', 'b')} as distance from op a, (select 0e0 as denoise, 6e0 as max_speech, 0.2e0 as min_silence, 0.15e0 as min_speech, 0.5e0 as threshold, false as overlap, 2 as speakers) b", OPT)
RANK = f"""rk as (select user_id as job_id, event_id as ord, value / 500 as accuracy, {R("case when event_id % 3 <> 0 and event_id % 4 <> 0 then value / 500 * 0.8e0 + (event_id % 11) / 11e0 * 0.1e0 + (event_id % 13) / 13e0 * 0.1e0 when event_id % 3 <> 0 then value / 500 * 0.9e0 + (event_id % 11) / 11e0 * 0.1e0 when event_id % 4 <> 0 then value / 500 * 0.85e0 + (event_id % 13) / 13e0 * 0.15e0 else value / 500 end")} as score from events)"""
add("rank_scores", [], "select ord, score from rk", RANK)
add("confidence_labels", [], f"""select job_id, score, margin, case when accuracy >= 0.8e0 and margin >= 0.03e0 then 'high' when accuracy >= 0.55e0 then 'medium' else 'low' end as confidence from (select *, coalesce({R("score - nx")}, 0e0) as margin from
(select *, row_number() over w as n, lead(score) over w as nx from rk window w as (partition by job_id order by score desc, ord)) where n = 1)""", RANK)
add("latency_stats", [], f"select event_type, count(*) as n, {R('avg(value)')} as mean, {R('list_sort(list(value))[cast(floor(count(value) / 2) as int) + 1]')} as median, {R('max(value)')} as max from events group by 1")
add("error_classes", ["v_status"], """select event_id, case when event_id % 100 = 99 or regexp_matches(message, '(?i)cancel') then 'CANCELLED' when regexp_matches(message, '(?i)model.+(not found|missing)') then 'MODEL_UNAVAILABLE'
when regexp_matches(message, '(?i)ENOSPC|no space|disk full') then 'NO_DISK_SPACE' when regexp_matches(message, '(?i)ENOENT|EACCES|EPERM|permission denied|access denied') then 'FILE_UNAVAILABLE'
when regexp_matches(message, '(?i)ENOMEM|out of memory|allocation failed') then 'OUT_OF_MEMORY' when regexp_matches(message, '(?i)worker.+(exit|ended|closed)|broken pipe|EPIPE') then 'WORKER_STOPPED'
when regexp_matches(message, '(?i)ffmpeg|invalid data|unsupported|decode|demux') then 'AUDIO_DECODE_FAILED' else 'TRANSCRIBE_FAILED' end as code from v_status""")
add("eta_labels", ["v_status"], """select event_id, case when v < 10 then '約10秒未満' when v < 60 then '約' || cast(ceil(v / 5) * 5 as int) || '秒' when v < 300 then '約' || cast(floor(t / 60) as int) || '分' || case when t % 60 <> 0 then (t % 60) || '秒' else '' end
else '約' || cast(ceil(v / 60) as int) || '分' end as eta, case when s >= 3600 then (s // 3600) || ':' else '' end || printf('%02d:%02d', (s // 60) % 60, s % 60) as elapsed
from (select event_id, greatest(1e0, value) as v, cast(ceil(greatest(1e0, value) / 10) * 10 as int) as t, cast(floor(elapsed_ms / 100) as bigint) as s from v_status)""")
add("slow_threshold", ["v_status"], f"""select event_id, {R("t")} as threshold_ms, coalesce(elapsed_ms > t, false) as slow from (select *, case when phase in ('overlap', 'separating') then greatest(90000e0, al) when phase = 'denoising' then greatest(60000e0, al)
when phase = 'vad' then greatest(45000e0, al) when phase = 'queued' then null when phase = 'recognizing' then 45000e0 when phase = 'finalizing' then 20000e0 else 60000e0 end as t from (select *, least(300000e0, greatest(0e0, value * 5) * 150) as al from v_status))""")
add("phase_lists", [], """select event_id, concat_ws(',', 'queued', 'preparing', 'decoding', case when event_id % 3 > 0 then 'denoising' end, 'vad', case when event_id % 2 = 0 then 'overlap' end, 'recognizing',
case when event_id % 10 = 0 then 'separating' end, 'finalizing') as phases from events""")
add("thread_budget", [], "select event_id, cast(greatest(1, least(4, greatest(1, event_id % 33 - 2) // greatest(1, user_id % 5))) as int) as threads from events")
add("clock_formats", ["v_seg"], f"select seg_id, {stamp('start_s', ',')} as srt, {stamp('start_s', '.')} as vtt, {clock('end_s')} as clock, floor(end_s) as parsed from v_seg")
add("trial_starts", [], """select event_id, case event_id % 3 when 0 then (event_id % 100)::double when 1 then case when event_id % 64 >= 60 then null else (event_id % 70) * 60e0 + event_id % 64 end
else case when event_id % 61 >= 60 or event_id % 62 >= 60 then null else 7200e0 + (event_id % 62) * 60 + event_id % 61 end end as seconds from events""")
add("speaker_labels", ["v_utt"], f"select recording_id, turn, {NAME} as name from v_utt")
add("safe_ids", [], "select page_id, case when s = '' then 'recording' else substr(s, 1, 80) end as safe from (select page_id, regexp_replace(regexp_replace(coalesce(url, ''), '[^\\p{L}\\p{N}_-]+', '-', 'g'), '^-+|-+$', '', 'g') as s from pages)")
add("stream_sessions", ["v_seg"], f"""select k, cast(session as int) as session, {R("min(start_s)")} as start_s, {R("max(start_s)")} as end_s, count(*) as n from (select *, sum(f) over (partition by k order by start_s rows unbounded preceding) as session from
(select recording_id * 10 + speaker as k, start_s, case when start_s - lag(start_s) over (partition by recording_id * 10 + speaker order by start_s) <= 300 then 0 else 1 end as f from v_seg)) group by 1, 2""")
add("queue_positions", [], """select queue, job_id, row_number() over (partition by queue order by event_id) as position from (select user_id % 20 as queue, user_id as job_id, event_id,
row_number() over (partition by user_id order by event_id) as n from events) where n = 1 and event_id % 9 <> 0""")
add("latest_partials", ["v_seg"], "select recording_id, seg_id, row_number() over (partition by recording_id order by start_s, seg_id) as place from (select *, row_number() over (partition by recording_id order by seg_id desc) as n from v_seg) where n <= 8")

# settings and reference rows
add("normalized_ranges", [], f"""select event_id, {R("a")} as start_s, {R("case when b > a then b else a + greatest(0.1e0, coalesce(f, 0.1e0)) end")} as end_s from (select *, coalesce(e1, e2, a + greatest(0e0, coalesce(d, f, 0e0))) as b from (
  select event_id, greatest(0e0, coalesce(case when event_id % 3 = 0 then value end, case when event_id % 2 = 0 then value - 20 end, 0e0)) as a, case when event_id % 5 = 0 then value + 3 end as e1,
  case when event_id % 7 = 0 then value - 50 end as e2, coalesce(case when event_id % 4 = 0 then value / 2 end, case when event_id % 9 = 0 then value / 3 end) as d, case when event_id % 11 <> 0 then value / 10 end as f from events))""")
add("reference_rows", ["v_utt"], f"""select recording_id, ord, speaker, text, normalized_text, {R("start_s")} as start_s, {R("end_s")} as end_s, operation from (select recording_id, cast(row_number() over (partition by recording_id order by turn) - 1 as int) as ord,
  case when speaker = 'system' then 'speaker-1' else speaker end as speaker, trim(text) as text, {norm("text")} as normalized_text, greatest(0e0, start_s) as start_s, greatest(0e0, end_s) as end_s,
  case when spk = 0 then 'insert' else 'replace' end as operation from v_utt where coalesce(spk <> 1, true)) where normalized_text <> ''""")
add("close_confirmation", [], """select event_id, unsaved, active, active or (asks and unsaved) as ask from (select event_id, event_id % 3 - 1 > 0 or event_id % 5 - 3 > 0 or event_id % 7 = 0 or floor(value / 400) > 0 as unsaved,
  (case when event_id % 2 = 0 then 0 else event_id % 11 - 9 end) > 0 or event_id % 13 = 0 as active, case when event_id % 4 <> 0 then event_id % 4 = 1 else true end as asks from events)""")
add("stem_options", [], f"""select event_id, {R("least(0.5e0, case when coalesce(t, 0) = 0 then 0.5e0 else t end)")} as threshold, {R("least(0.12e0, value / 2000)")} as min_speech, {R("least(0.18e0, case when coalesce(s, 0) = 0 then 0.18e0 else s end)")} as min_silence,
  {R("least(4e0, value / 60)")} as max_speech from (select *, case when event_id % 4 <> 0 then value / 500 end as t, case when event_id % 3 <> 0 then value / 1500 end as s from events)""")
add("recognizer_modes", [], f"""select event_id, case when u or (event_id % 7 <> 0 and event_id % 4 = 0) then 'modified_beam_search' else 'greedy_search' end as method, {R("case when u then case when event_id % 6 <> 0 then value / 100 else 2e0 end else 0e0 end")} as hotword_score
from (select *, event_id % 3 > 0 and (event_id % 5 = 0 or event_id % 2 = 0) as u from events)""")
add("inferred_ranges", ["v_utt"], f"""select recording_id, turn, {R("case when gap then pb when cr then greatest(pa, s) when pb is not null then pb when s is not null then greatest(0e0, s - 1) else 0e0 end")} as start_s,
  {R("case when gap then s when cr then least(pb, e) when pb is not null then pb + 1 when s is not null then s else 1e0 end")} as end_s from (select *, {R("s - pb")} >= 0.05e0 as gap, {R("least(pb, e) - greatest(pa, s)")} >= 0.1e0 and s is not null and pb is not null as cr from (
  select *, lag(s) over (partition by recording_id order by turn) as pa, lag(e) over (partition by recording_id order by turn) as pb from
  (select recording_id, turn, case when speaker <> 'system' then start_s end as s, case when speaker <> 'system' then end_s end as e from v_utt)))""")
add("clamped_rows", ["v_utt"], f"""select recording_id, turn, {R("floor(a * 100 + 0.5e0) / 100")} as start_s, {R("floor(greatest(a + 0.05e0, least(20e0, end_s)) * 100 + 0.5e0) / 100")} as end_s from
(select *, greatest(1e0, least(20e0 - 0.05e0, case when spk is null then 1e0 else start_s end)) as a from v_utt)""")
add("hypothesis_rows", ["v_seg"], f"""select recording_id, seg_id from v_seg a where exists (select 1 from v_seg b where b.kind = 'error' and b.recording_id = a.recording_id and b.end_s > a.start_s and b.start_s < a.end_s
  and ({R("least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)")} >= 0.05e0 or ((a.start_s + a.end_s) / 2 between b.start_s and b.end_s)))
union all select recording_id, seg_id from v_seg a where not exists (select 1 from v_seg b where b.kind = 'error' and b.recording_id = a.recording_id)""")
add("preset_upsert", [], """select user_id, id, name, ord from (select *, row_number() over (partition by user_id order by ord, id) as k from (select *, row_number() over (partition by user_id, lower(name) order by nw desc, ord desc) as j from
(select *, row_number() over (partition by user_id, id order by nw desc, ord desc) as i from (select user_id, event_id as ord, 'p' || (event_id % 7) as id, 'Name ' || case when event_type = 'signup' then 'a' else 'A' end || (event_id % 5) as name,
  case when event_type = 'signup' then 1 else 0 end as nw from events)) where i = 1) where j = 1) where k <= 20""")


add("sample_indices", ["v_seg"], "select seg_id, cast(least(57600000, greatest(0, floor(start_s * 16000 + 0.5e0))) as bigint) as first, cast(greatest(0, floor(end_s * 16000 + 0.5e0)) as bigint) as last from v_seg")
add("local_parts", ["v_seg"], f"""select recording_id, idx, cast(row_number() over (partition by recording_id, idx order by start_s, seg_id nulls first, part) as int) as part_no, start_s, end_s from
(select recording_id, idx, seg_id, part, start_s, end_s from hit union all select recording_id, idx, seg_id, part, start_s, end_s from alone)""", WINS + f""",
lo as (select recording_id, idx, greatest(0e0, overlap_start - start_s - 0.15e0) as o0, least(end_s - start_s, overlap_end - start_s + 0.15e0) as o1 from win),
sp0 as (select w.recording_id, w.idx, s.seg_id, {R("greatest(0e0, s.start_s - w.start_s)")} as start_s, {R("least(w.end_s, s.end_s) - w.start_s")} as end_s from win w join v_seg s on s.recording_id = w.recording_id and s.end_s > w.start_s and s.start_s < w.end_s),
""" + split("sp0", "spp", "recording_id, idx, seg_id", 4.0) + f""",
hit as (select spp.* from spp join lo using (recording_id, idx) where {R("least(end_s, o1) - greatest(start_s, o0)")} >= 0.04e0),
al0 as (select recording_id, idx, cast(null as bigint) as seg_id, o0 as start_s, o1 as end_s from lo where {R("o1 - o0")} >= 0.25e0 and not exists (select 1 from hit where hit.recording_id = lo.recording_id and hit.idx = lo.idx)),
""" + split("al0", "alone", "recording_id, idx, seg_id", 4.0))  # fmt: skip
add("boundary_variants", ["v_seg"], f"""select seg_id, variant, {R("s")} as start_s, {R("e")} as end_s from
(select *, row_number() over (partition by seg_id, floor(s * 1000 + 0.5e0), floor(e * 1000 + 0.5e0) order by variant) as n from bv where {R("e - s")} >= 0.1e0) where n = 1""", """ab as (select seg_id, greatest(0e0, start_s - 30) as a, greatest(greatest(0e0, start_s - 30) + 0.1e0, end_s) as b from v_seg),
bv as (select seg_id, variant, greatest(greatest(0e0, a - 0.3e0), a + da) as s, least(least(80000e0, b + 0.3e0), b + db) as e from ab, (values (0, 0e0, 0e0), (1, -0.2e0, 0e0), (2, 0e0, 0.2e0), (3, -0.2e0, 0.2e0), (4, 0.1e0, -0.1e0)) v(variant, da, db))""")  # fmt: skip
add("guard_flags", ["v_seg"], f"select seg_id, {R('end_s - start_s')} < 0.05e0 as short_selection, {R('end_s - start_s')} < 0.1e0 as short_window from v_seg")
add("work_totals", ["v_seg"], "select recording_id, count(*) as items, round(sum(greatest(0e0, case when seg_id % 9 <> 0 then end_s else 0e0 end - start_s)), 3) as seconds from v_seg group by 1")
add("range_bounds", ["v_seg"], f"""select recording_id, case when recording_id % 5 = 0 then 100e0 else {R("min(start_s)")} end as start_s, case when recording_id % 7 = 0 then 9000e0 else {R("max(end_s)")} end as end_s from v_seg group by 1""")
add("manual_tracks", ["v_utt"], f"""select recording_id, turn, 'manual:' || speaker as speaker, {R("greatest(0e0, start_s - 3e0)")} as start_s, {R("end_s - 3e0")} as end_s from v_utt where end_s > start_s and end_s - 3e0 > greatest(0e0, start_s - 3e0)""")
add("cache_fill", [], "select case when event_id % 3 = 0 then 'cached' else 'computed' end as origin, count(*) as n from events group by 1")
add("similar_overlaps", ["v_utt"], f"""select a.recording_id, a.turn, b.turn as r_turn from su a join su b on a.recording_id = b.recording_id and a.end_s > a.start_s and a.end_s > greatest(0e0, b.start_s + 1) and a.start_s < greatest(0e0, b.end_s + 1)
and greatest(0e0, b.end_s + 1) > greatest(0e0, b.start_s + 1) where {R("least(a.end_s, greatest(0e0, b.end_s + 1)) - greatest(a.start_s, greatest(0e0, b.start_s + 1))")} > 0.03e0 and case when contains(a.norm, b.norm) or contains(b.norm, a.norm) or least(length(a.norm), length(b.norm)) >= 0.67e0 * greatest(length(a.norm), length(b.norm))
then {R(asim("a.norm", "b.norm"))} >= 0.68e0 else false end""",
    f"su as (select recording_id, turn, start_s, end_s, {norm(chr(34) + 'txt' + chr(34))} as norm from (select *, regexp_replace(text, '[^\\x20-\\x7E]', '~', 'g') as txt from v_utt) where {norm(chr(34) + 'txt' + chr(34))} <> '')")
THREE = N4 + """,
th as (select utt_id, [r1, r2, substr(r2, 1, 10) || substr(r1, 1, 10)] as r, [substr(h2, 1, 10) || substr(h1, 1, 10), h1, h2] as h, h1 || h2 as mix from np),
od as (select [1, 2, 3] as o union all select [1, 3, 2] union all select [2, 1, 3] union all select [2, 3, 1] union all select [3, 1, 2] union all select [3, 2, 1])"""
add("pit_cer", ["v_pair2"], """select utt_id, distance, assignment from (select *, row_number() over (partition by utt_id order by distance, assignment) as n from
(select utt_id, levenshtein(r[1], h[o[1]]) + levenshtein(r[2], h[o[2]]) + levenshtein(r[3], h[o[3]]) as distance, (o[1] - 1) || ',' || (o[2] - 1) || ',' || (o[3] - 1) as assignment from th, od)) where n = 1""", THREE)
add("cp_cer", ["v_pair2"], "select utt_id, min(levenshtein(r[o[1]] || r[o[2]] || r[o[3]], mix)) as distance from th, od group by 1", THREE)
def talks(most: int) -> str:
    return nv("v_pair", "ref", "hyp") + f""",
tk as (select doc_id, pos // (2 + doc_id % {most - 1}) as talk, list(ref order by pos) as r, list(hyp order by pos * 3 % 8, pos) as h, len(r) as n from np group by 1, 2)"""


LAYERS = ",\n".join(f"""l{k} as (select l.doc_id, l.talk, l.m | (1 << j) as m, min(l.d + ct.d) as d from l{k - 1} l join ct on ct.doc_id = l.doc_id and ct.talk = l.talk and ct.i = {k} and (l.m >> ct.j) & 1 = 0 group by 1, 2, 3)""" for k in range(1, 9))
add("pit_cer_many", ["v_pair"], "select doc_id, talk, n as speakers, d as distance, n as used, d as assigned from tk join (" + " union all ".join(f"select doc_id, talk, {k} as n, min(d) as d from l{k} group by 1, 2" for k in range(1, 9)) + ") using (doc_id, talk, n)", talks(8) + f""",
ct as (select doc_id, talk, i, j, levenshtein(r[i], h[j + 1]) as d from (select doc_id, talk, r, h, i, unnest(range(0, n)) as j from (select doc_id, talk, r, h, n, unnest(range(1, n + 1)) as i from tk))),
l0 as (select doc_id, talk, cast(0 as bigint) as m, cast(0 as bigint) as d from tk),
{LAYERS}""")  # fmt: skip
add("cp_cer_many", ["v_pair"], """select doc_id, talk, n as speakers, min(levenshtein(list_aggregate(list_transform(o, lambda i: r[i]), 'string_agg', ''), mix)) as distance
from (select doc_id, talk, r, n, list_aggregate(h, 'string_agg', '') as mix from tk) join od on len(o) = n group by 1, 2, 3""", talks(4) + """,
s4 as (select unnest([1, 2, 3, 4]) as a), od as (select [1] as o union all select [a.a, b.a] from s4 a, s4 b where a.a <> b.a and greatest(a.a, b.a) = 2
  union all select [a.a, b.a, c.a] from s4 a, s4 b, s4 c where a.a <> b.a and c.a <> a.a and c.a <> b.a and greatest(a.a, b.a, c.a) = 3
  union all select [a.a, b.a, c.a, d.a] from s4 a, s4 b, s4 c, s4 d where a.a <> b.a and c.a <> a.a and c.a <> b.a and d.a not in (a.a, b.a, c.a))""")  # fmt: skip
# the engine's levenshtein counts bytes: each pair's characters are written as its own alphabet of single bytes first
add("edit_distance_original", ["v_orig"], f"""select utt_id, length(ref) as chars, d as distance, {R('1 - d / greatest(1, length(ref), length(hyp))::double')} as similarity from
(select *, levenshtein(list_aggregate(list_transform(string_split(ref, ''), lambda c: chr(cast(list_position(abc, c) as int))), 'string_agg', ''), list_aggregate(list_transform(string_split(hyp, ''), lambda c: chr(cast(list_position(abc, c) as int))), 'string_agg', '')) as d
from (select *, list_distinct(string_split(ref || hyp, '')) as abc from v_orig))""")  # fmt: skip
SHARE = lambda a, b: f"""coalesce(list_sum(list_transform(list_filter(list_distinct(string_split({a}, '')), lambda c: c <> ''), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))))), 0)"""
add("evaluate_cases", ["v_pair2"], f"""select utt_id, length(rr) as reference_chars, least(levenshtein(r1 || r2, h1), levenshtein(r2 || r1, h1)) as mixture_distance, least(levenshtein(r1, h1) + levenshtein(r2, h2), levenshtein(r1, h2) + levenshtein(r2, h1)) as separated_distance,
cast({SHARE("rr", "h1")} as bigint) as matched_before, cast({SHARE("rr", "aft")} as bigint) as matched_after, length(aft) - length(h1) as added_chars, cast({SHARE("rr", "aft")} - {SHARE("rr", "h1")} as bigint) as recovered_chars
from (select *, r1 || r2 as rr, case when utt_id % 3 <> 0 then h1 || substr(h2, 1, 20) else h1 end as aft from np)""", N4)  # fmt: skip
add("clean_remap", ["v_cases"], """select count(*) filter (ok) as cases, count(*) filter (not ok) as skipped, cast(coalesce(sum(case when ok then mixture_distance + 1 end), 0) as bigint) as mixture_distance,
cast(coalesce(sum(case when ok then reference_chars end), 0) as bigint) as reference_chars from (select *, case_id % 4 <> 0 and case_id % 7 <> 0 as ok from v_cases)""")
add("reference_texts", ["v_utt"], f"select recording_id, string_agg({norm('text')}, '' order by turn) as reference_text from v_utt where {norm('text')} <> '' group by 1")
add("processing_costs", [], f"select event_id as job_id, {R('case when event_id % 2 = 0 then 2e0 else 0e0 end + (event_id % 7) / 5e0')} as cost from events")
RMS = lambda v: f"sqrt(list_inner_product({v}, {v}) / len({v}))"
add("source_shares", [], f"""select vec_id, {R(f"{RMS('v[1:20]')} / ({RMS('v[1:20]')} + {RMS('v[21:64]')})")} as first, {R(f"{RMS('v[21:64]')} / ({RMS('v[1:20]')} + {RMS('v[21:64]')})")} as second from vd""", VEC)
add("reframed", [], f"""select stream, cast(p // 100 as bigint) as frame, count(*) as n, {R("sum(x)")} as total from (select stream, x, row_number() over (partition by stream order by vec_id, i) - 1 as p from
(select vec_id % 7 as stream, vec_id, unnest(v[1:vec_id % 50 + 1]) as x, unnest(range(1, vec_id % 50 + 2)) as i from vd)) group by 1, 2 having count(*) = 100""", VEC)
add("padded_samples", [], f"select vec_id, cast(len(v) + 2 * 160 as bigint) as n, {R('list_sum(v)')} as total from vd", VEC)
add("phase_state", [], """select event_id, at_s - min(at_s) over (partition by job_id, r) as in_phase_s, (at_s - min(at_s) over (partition by job_id, r)) * 1000 > case when phase = 'recognizing' then 45000e0 else 60000e0 end as slow from
(select *, sum(f) over (partition by job_id order by at_s rows unbounded preceding) as r from (select *, case when lag(phase) over (partition by job_id order by at_s) = phase then 0 else 1 end as f from
(select event_id, user_id as job_id, event_id * 20e0 as at_s, case when event_id % 4 = 0 then 'decoding' else 'recognizing' end as phase from events)))""")
add("partial_results", [], "select conv_id as recording_id, turn from conversations where turn % 3 <> 0 and trim(coalesce(text, '')) <> ''")
add("time_labels", ["v_seg"], f"""select seg_id, {clock("start_s")} as clock, lpad(cast(cast(floor(start_s / 60) as bigint) as varchar), cast(greatest(2, length(cast(cast(floor(start_s / 60) as bigint) as varchar))) as int), '0') || ':' || lpad(cast(cast(floor(start_s) as bigint) % 60 as varchar), 2, '0') as minutes,
case when floor(start_s / 10) >= 3600 then {clock("(start_s / 10)")} else lpad(cast(cast(floor(floor(start_s / 10) / 60) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor(start_s / 10) as bigint) % 60 as varchar), 2, '0') end as trial from v_seg""")
add("number_lists", [], "select event_id, case when event_id % 3 = 0 then 1 else 2 end as n, event_id % 10 + case when event_id % 3 = 0 then 0e0 else 2.5e0 end as total from events")
add("settings_fingerprints", [], "select event_id as job_id, sha256(cast(floor((event_id % 7) / 5e0 * 10) as bigint) || '|' || case when event_id % 4 <> 0 then cast(event_id % 6 as varchar) else '' end) as fingerprint from events")
add("valid_times", ["v_utt"], "select recording_id, turn, coalesce(case when turn % 6 = 5 then 0e0 else end_s end > case when turn % 4 <> 0 then start_s end, false) as timed from v_utt")
add("hotword_lines", [], "select word, count(*) as n from (select trim(unnest(string_split(text, chr(10)))) as word from conversations) where word <> '' group by 1")
add("complete_model_sets", [], """select model, folder from (select *, row_number() over (partition by model order by place) as r from (select c.model, f.folder, f.place, count(distinct c.name) as n from fl f join ct c on f.name = c.name and (c.bytes is null or c.bytes = f.bytes) group by 1, 2, 3) h
join (select model, count(*) as need from ct group by 1) using (model) where n = need) where r = 1""", """fl as (select distinct cast(user_id % 40 as varchar) as folder, user_id % 40 as place, 'f' || (event_id % 13) as name, event_id % 3 as bytes from events),
ct as (select 'm' || (event_id % 4) as model, 'f' || (event_id % 12) as name, min(case when event_id % 12 < 6 then event_id % 2 end) as bytes from events group by 1, 2)""")  # fmt: skip
add("phase_maps", ["v_status"], "select job_id, count(distinct phase) as phases, count(*) filter (phase = 'vad') as vad, bool_or(phase = 'queued') as was_queued from v_status group by 1")
add("correction_blocks", ["v_utt"], f"""select recording_id, id, {R("case when good then a else r0 end")} as start_s, {R("case when good then b else r1 end")} as end_s, {R("r0")} as source_start, {R("r1")} as source_end, whole as replace_all, n from
(select *, coalesce(b > a, false) as good from (select recording_id, id, r0, r1, whole, n, case when whole or not first then r0 else lo end as a, case when whole or not last then r1 else hi end as b from cg))""", """cr as (select recording_id, turn, floor(turn / 4) as bk, start_s, end_s, turn % 3 <> 1 and end_s > start_s as own, turn % 5 = 0 and end_s > start_s as src, min(start_s) over w as r0, max(end_s) over w as r1 from v_utt window w as (partition by recording_id, floor(turn / 4))),
cg as (select recording_id, 'b' || cast(bk as bigint) as id, r0, r1, bk % 3 = 2 as whole, count(*) as n, min(least(case when own then start_s + 0.25e0 end, case when src then start_s end)) as lo, max(greatest(case when own then end_s + 0.25e0 end, case when src then end_s end)) as hi,
  arg_min(own, turn) as first, arg_max(own, turn) as last from cr where turn % 11 <> 10 group by recording_id, bk, r0, r1)""")  # fmt: skip


# sessions, ordered results, caches and sound files
add("session_events", ["v_seg"], f"""select * from (
select session, 'error' as event, seq, cast(null as double) as start_s, cast(null as double) as end_s, cast(null as bigint) as frames, case when kind = 'stop' then 'not-running' else 'already-running' end as detail from sl where (kind = 'stop') <> coalesce(c = 'start', false) and kind in ('start', 'stop')
union all select session, 'segment', out_seq, {R("a")}, {R("b")}, n, null from si where out_seq is not null
union all select session, 'done', stop_seq, null, {R("fed")}, segments, 'stop' from (select session, run, stop_seq, count(*) filter (out_seq is not null) as segments, coalesce(sum(fed), 0e0) as fed from se left join si using (session, run, stop_seq) group by 1, 2, 3) where stop_seq is not null)""", """sq as (select recording_id as session, row_number() over (partition by recording_id order by start_s, seg_id) - 1 as seq, case when seg_id % 10 = 0 then 'start' when seg_id % 10 = 9 then 'stop' when seg_id % 50 = 5 then 'cancel' else 'frame' end as kind, start_s, end_s from v_seg),
sl0 as (select *, last_value(case when kind <> 'frame' then kind end ignore nulls) over (partition by session order by seq rows between unbounded preceding and 1 preceding) as c from sq),
sl as (select *, sum(case when kind = 'start' and c is distinct from 'start' then 1 else 0 end) over (partition by session order by seq rows unbounded preceding) as run from sl0),
se as (select session, run, max(case when kind = 'stop' and c = 'start' then seq end) as stop_seq from sl group by 1, 2 having run > 0),
sf as (select *, case when start_s - lag(end_s) over (partition by session, run order by seq) >= 120e0 then 1 else 0 end as f from sl where kind = 'frame' and c = 'start'),
sg as (select *, sum(f) over (partition by session, run order by seq rows unbounded preceding) as g from sf),
sh as (select session, run, g, arg_min(start_s, seq) as a, arg_max(end_s, seq) as b, count(*) as n, min(seq) as first_seq, sum(end_s - start_s) as fed from sg group by 1, 2, 3),
si as (select sh.*, se.stop_seq, coalesce(lead(first_seq) over (partition by session, run order by g), se.stop_seq) as out_seq from sh join se using (session, run))""")  # fmt: skip
add("results_in_order", ["v_seg"], """select session, seq, case when error is null then text end as text, error from rs join (select session, min(seq) as gap from (select session, seq from rs0 where lost union all select session, max(seq) + 1 from rs0 group by 1) group by 1) using (session) where seq < gap and (error is not null or text <> ' ')""",
    "rs0 as (select recording_id as session, row_number() over (partition by recording_id order by start_s, seg_id) - 1 as seq, case when seg_id % 5 = 0 then ' ' else kind end as text, case when seg_id % 7 = 0 then 'lost' end as error, seg_id % 199 = 0 as lost from v_seg), rs as (select * from rs0 where not lost)")
add("cache_hits", [], """select cache, seq, entry, p is not null and (select count(*) from ca b where b.cache = a.cache and b.seq > a.p and b.seq < a.seq and (b.n is null or b.n > a.seq)) < 12 as hit from ca a""", """ca as (select *, lag(seq) over (partition by cache, entry order by seq) as p, lead(seq) over (partition by cache, entry order by seq) as n
  from (select user_id % 20 as cache, event_id as seq, event_type || '-' || cast(floor(value) % 9 as int) as entry from events))""")
add("sound_ranges", [], """select form, stream, count(*) as n, cast(sum(floor(greatest(-1e0, least(1e0, cast(x as double))) * 32767 + 0.5e0)) as bigint) as total from
(select stream, x, row_number() over (partition by stream order by vec_id, i) as p from (select vec_id % 16 as stream, vec_id, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings)), (values ('wav'), ('raw')) f(form)
where p > 800 and p <= 2400 group by 1, 2""")


# the gate of separated speech. Accented letters are written as control characters, which normalised texts don't have: the engine's levenshtein counts bytes
ACCENTS = "áàâäæçéèêëíîïñóôöœúùûüÿß"
plain = lambda x: f"translate({x}, '{ACCENTS}', {' || '.join(f'chr({i})' for i in range(1, len(ACCENTS) + 1))})"
meet = lambda a, b: f"least({a}.end_s, {b}.end_s) - greatest({a}.start_s, {b}.start_s)"
add("gate_reasons", ["v_utt"], f"""select recording_id, turn as window, reason, case when reason = 'novel-transcript' then new else 0 end as added from (select *, case when turn % 10 = 5 then 'missing-metrics' when turn % 9 = 4 then 'silent-stem'
  when turn % 7 = 3 then 'correlated-stems' when text = '' then 'missing-stem-transcript' when {tsim("n0", "n1")} >= 0.88e0 then 'duplicate-stem-transcript' when turn % 8 = 7 then 'missing-speaker-embedding'
  when turn % 8 = 6 then 'same-speaker-embedding' when likeness is null then 'missing-baseline-anchor' when likeness < 0.45e0 then 'unanchored-transcript' when new = 0 then 'no-novel-transcript' else 'novel-transcript' end as reason from gj)""", f"""gu as (select *, {plain(norm("coalesce(text, '')"))} as n from v_utt),
gw as (select recording_id, turn, coalesce(text, '') as text, start_s, end_s, n as n0, case when turn % 4 = 1 then n else {plain(norm("reverse(coalesce(text, ''))"))} end as n1 from gu),
gh as (select *, 0 as place, n0 as n from gw union all select * replace (start_s + 0.25e0 as start_s, end_s + 0.25e0 as end_s), 1, n1 from gw),
gp as (select h.recording_id, h.turn, h.place, {asim("h.n", "b.n")} as a, {meet("h", "b")} > 0.03e0 as now from gh h join gw w using (recording_id, turn) join gu b on b.recording_id = h.recording_id and b.end_s > b.start_s and w.end_s + 1 > w.start_s - 1
  and b.end_s > w.start_s - 1 and b.start_s < w.end_s + 1),
gm as (select recording_id, turn, place, max(a) as likeness, bool_or(now and a >= 0.68e0) as known from gp group by 1, 2, 3),
gf as (select h.recording_id, h.turn, h.place, likeness, not coalesce(known, false) and length(h.n) >= 2 and {meet("h", "w")} > 0 as fresh from gh h join gw w using (recording_id, turn) left join gm using (recording_id, turn, place)),
gj as (select w.*, f.likeness, f.fa + case when f.fb = 1 and not (f.fa = 1 and w.end_s - w.start_s - 0.25e0 > 0.03e0 and {asim("w.n0", "w.n1")} >= 0.68e0) then 1 else 0 end as new
  from gw w join (select recording_id, turn, max(likeness) as likeness, max(case when place = 0 and fresh then 1 else 0 end) as fa, max(case when place = 1 and fresh then 1 else 0 end) as fb from gf group by 1, 2) f using (recording_id, turn))""")  # fmt: skip


# synthetic overlaps
X32 = lambda x, by: f"xor({x}, ({x} << {by}) & 4294967295)"
add("mix_plans", ["v_utt"], """select cast(i as bigint) as idx, source_a, source_b, [-6e0, 0e0, 6e0][i % 3 + 1] as snr_db, [0.25e0, 0.5e0, 0.75e0, 1e0][(i // 3) % 4 + 1] as overlap_ratio, case when i % 2 = 0 then 'a' else 'b' end as lead from
(select *, row_number() over (order by t) - 1 as i from (select least(u.id, v.id) as lo, greatest(u.id, v.id) as hi, min(t) as t, arg_min(u.id, t) as source_a, arg_min(v.id, t) as source_b from xb
  join xr u on u.who = a and u.place = cast(floor(x2 * na) as bigint) join xr v on v.who = b and v.place = cast(floor(x3 * nb) as bigint) group by 1, 2)) where i < (select count(*) // 2 from xu)""", f"""xu as (select recording_id * 1000 + turn as id, speaker from v_utt where trim(coalesce(text, '')) <> ''),
xs as (select speaker, n, row_number() over (order by f) - 1 as who from (select speaker, count(*) as n, min(id) as f from xu group by 1)),
xr as (select id, who, row_number() over (partition by who order by id) - 1 as place from xu join xs using (speaker)),
x0 as (with recursive st as (select 0 as k, cast(2024 as bigint) as x union all select k + 1, {X32("w", 5)} from (select k, xor(v, v >> 17) as w from (select k, {X32("x", 13)} as v from st where k < 8 * (select count(*) from xu)))) select k - 1 as k, x / 4294967296::double as x from st where k > 0),
xa as (select k // 4 as t, max(case when k % 4 = 0 then x end) as x0, max(case when k % 4 = 1 then x end) as x1, max(case when k % 4 = 2 then x end) as x2, max(case when k % 4 = 3 then x end) as x3 from x0 group by 1),
xc as (select *, cast(floor(x0 * (select count(*) from xs)) as bigint) as a, cast(floor(x1 * ((select count(*) from xs) - 1)) as bigint) as b0 from xa),
xb as (select c.*, c.b, p.n as na, q.n as nb from (select *, b0 + case when b0 >= a then 1 else 0 end as b from xc) c join xs p on p.who = c.a join xs q on q.who = c.b)""")  # fmt: skip
add("mixed_sounds", [], f"""select idx, count(*) as n, {R("sum(m * m)")} as energy, {R("sum(abs(y))")} as second, {R("max(abs(m))")} as peak from
(select idx, (x + y) * k as m, y * k as y from (select *, case when max(abs(x + y)) over (partition by idx) > 0.98e0 then 0.98e0 / max(abs(x + y)) over (partition by idx) else 1e0 end as k from
(select idx, p, sum(x) as x, sum(y) as y from (select l.idx, s.p + case when l.idx % 2 = 0 then 0 else l.o end as p, (s.x - l.ma) * l.ga as x, 0e0 as y from zl l join zs s on s.id = l.idx
union all select l.idx, s.p + case when l.idx % 2 = 0 then l.o else 0 end, 0e0, (s.x - l.mb) * l.gb from zl l join zs s on s.id = (l.idx + 1) % 16) group by 1, 2))) group by 1""", """zs as (select vec_id % 16 as id, x, row_number() over (partition by vec_id % 16 order by vec_id, i) - 1 as p from (select vec_id, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
zm as (select id, count(*) as n, avg(x) as mean, sqrt(greatest(0, var_pop(x))) as rms from zs group by 1),
zl as (select a.id as idx, a.mean as ma, b.mean as mb, 0.1e0 / a.rms as ga, 0.1e0 * pow(10e0, -((a.id % 3 - 1) * 6) / 20e0) / b.rms as gb,
  greatest(0, case when a.id % 2 = 0 then a.n else b.n end - greatest(1, cast(floor(least(a.n, b.n) * ((a.id % 4 + 1) / 4e0) + 0.5e0) as bigint))) as o from zm a join zm b on b.id = (a.id + 1) % 16 where least(a.n, b.n) >= 250)""")  # fmt: skip

add("speech_segments", [], f"""select cast(path as varchar) as path, {R("min(k) / 10e0")} as start_s, {R("(max(k) + 1) / 10e0")} as end_s, cast(count(*) as int) as frames from (select *, sum(f) over (partition by path order by k rows unbounded preceding) as g from
(select path, k, case when k - lag(k) over (partition by path order by k) <= 2 then 0 else 1 end as f from sf where loud)) group by path, g""", """sf as (select path, k, sqrt(list_sum(list_transform(x, lambda v: v::double * v::double)) / 16) >= 0.13e0 as loud from
  (select vec_id % 5 as path, row_number() over (partition by vec_id % 5 order by vec_id, q) - 1 as k, embedding[q * 16 + 1:q * 16 + 16] as x from embeddings, range(0, 4) r(q)))""")  # fmt: skip


# reports and maps
add("percent_labels", ["v_status"], "select event_id, case when phase <> 'queued' then printf('%.1f%%', floor(value * 2) / 1000e0 * 100) else '-' end as label from v_status")
add("report_markdown", ["v_cases"], f"""select '| dataset | cases | mixture_cer | separated_cer | gate_rate |' || chr(10) || '|-|-|-|-|-|' || chr(10) || string_agg('| ' || coalesce(dataset, 'all') || ' | ' || cases || ' | ' || mixture_cer || ' | ' || separated_cer || ' | ' || gate_rate || ' |', chr(10)
order by dataset nulls first) as content from (select dataset, {REPORT} from v_cases group by grouping sets ((), (dataset)))""")
add("export_json", ["v_utt"], """select recording_id, '{"segments":[' || string_agg('{"idx":' || turn || ',"start":' || start_s || ',"end":' || end_s || ',"text":' || cast(to_json(text) as varchar) || case when spk is null then '' else ',"speaker":' || spk end || '}', ',' order by turn) || ']}' as content from v_utt group by 1""")
add("tune_speaker_map", ["v_seg"], "select recording_id, cluster, label, score from (select *, unnest(kept) as k from fin) join sc using (recording_id, n) where k = n", """sc as (select *, row_number() over (partition by recording_id order by score desc, cluster, label) as n from
  (select a.recording_id, a.speaker as cluster, b.speaker as label, round(sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)), 3) as score from v_seg a join v_seg b on a.recording_id = b.recording_id and a.end_s > b.start_s and a.start_s < b.end_s
   and a.end_s > a.start_s and b.end_s > b.start_s where a.speaker < 2 and b.speaker >= 2 group by 1, 2, 3) where score > 0),
fo as (with recursive f as (select distinct recording_id, cast(0 as bigint) as n, cast([] as int[]) as cs, cast([] as int[]) as ls, cast([] as bigint[]) as kept from sc
  union all select f.recording_id, s.n, case when free then list_append(cs, s.cluster) else cs end, case when free then list_append(ls, s.label) else ls end, case when free then list_append(kept, s.n) else kept end
  from (select f.*, s.n as m, s.cluster, s.label, not list_contains(cs, s.cluster) and not list_contains(ls, s.label) as free from f join sc s on s.recording_id = f.recording_id and s.n = f.n + 1) f join sc s on s.recording_id = f.recording_id and s.n = f.m) select * from f),
fin as (select recording_id, kept, unnest(kept) as n from (select recording_id, arg_max(kept, n) as kept from fo group by 1))""")  # fmt: skip

# manifests from transcripts: the cases of parsed lines
PREP = PARSED + f""",
sg as (select recording_id, turn as seg_id, trim(speaker) as speaker, start_s, end_s, trim(text) as text from pw where warning is null and trim(speaker) <> '' and {norm("text")} <> ''),
""" + PAIRS.replace("v_seg", "sg") + ",\n" + merged("pairs", "isl") + f""",
ac as (select i.recording_id, i.start_s as o0, s.* exclude (recording_id) from isl i join sg s on i.recording_id = s.recording_id and s.end_s > i.start_s and s.start_s < i.end_s),
ag as (select recording_id, o0, count(distinct speaker) as speakers, string_agg(cast(seg_id as varchar), '|' order by cast(seg_id as varchar)) as ids, min(start_s) as a, max(end_s) as b from ac group by 1, 2),
an as (select *, row_number() over (partition by recording_id, ids order by o0) as n from ag),
cs as (select *, speakers <> 2 or b - a > 25e0 + 1e-6 as bad from an where speakers <> 2 or n = 1),
sp as (select recording_id, o0, speaker, min(start_s) as f, arg_min(end_s, start_s) as g, sum(length(text)) as n from ac group by 1, 2, 3),
rf as (select recording_id, o0, string_agg(speaker || ':' || n, ' ' order by f, g, speaker) as refs from sp group by 1, 2),
nm as (select cs.recording_id, 'call-' || cs.recording_id || '-overlap-' || lpad(cast(row_number() over (partition by cs.recording_id order by o0) as varchar), 3, '0') || ' ' || refs as line, o0 from cs join rf using (recording_id, o0) where not bad)"""
add("prepared_manifests", ["v_lines"], """select r.recording_id, coalesce(c.cases, 0) as cases, coalesce(k.skipped, 0) as skipped, coalesce(w.warnings, 0) as warnings, cast(0 as bigint) as faults, coalesce(c.listing, '') as listing from (select distinct recording_id from v_lines) r
left join (select recording_id, count(*) as cases, string_agg(line, ';' order by o0) as listing from nm group by 1) c using (recording_id)
left join (select recording_id, count(*) as skipped from cs where bad group by 1) k using (recording_id) left join (select recording_id, count(*) as warnings from pw where warning is not null group by 1) w using (recording_id)""", PREP)

add("report_json", ["v_cases"], f"""select '2024-01-01T00:00:00.000Z' as generatedAt, (select count(*) from v_cases) as cases, (select mixture_cer from (select {REPORT} from v_cases)) as mixture_cer,
(select string_agg(dataset || ' ' || cases || ' ' || cer_delta, ';' order by dataset) from (select dataset, {REPORT} from v_cases group by 1)) as by_dataset,
(select string_agg(snr_db || ' ' || overlap_ratio || ' ' || cases || ' ' || separation_rtf, ';' order by snr_db, overlap_ratio) from (select snr_db, overlap_ratio, {REPORT} from v_cases group by 1, 2)) as by_condition""")
add("stem_pairs_by_conversation", [], "select id, k0 as speaker0, k1 as speaker1 from (select *, row_number() over (partition by id order by s, k0, k1, d0, d1) as n from pt) where n = 1 and d0 <= 0.95e0 and d1 <= 0.95e0", VEC + """,
cx as (select talk, label, list(x order by i) as c from (select vec_id % 9 as talk, label, i, avg(u[i]) as x from vn, range(1, 65) r(i) group by 1, 2, 3) group by 1, 2),
cy as (select talk, label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as c from cx),
dt as (select vec_id, cy.label as k, round(1 - list_inner_product(u, c), 9) as d0, round(1 - list_inner_product(list_reverse(u), c), 9) as d1 from vn e join cy on cy.talk = e.vec_id % 9),
pt as (select a.vec_id as id, a.k as k0, b.k as k1, a.d0, b.d1, round(a.d0 + b.d1, 9) as s from dt a join dt b on a.vec_id = b.vec_id and a.k <> b.k)""")  # fmt: skip
