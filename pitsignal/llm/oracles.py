"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from pitsignal.llm.boilerplate import FLOOR, MAX_RATIO
from pitsignal.llm import topics
from pitsignal.llm.mixing import LAZY_ROUNDS, ROUNDS, TOLERANCE
from pitsignal.llm.quality_rules import ITERATIONS, MIN_WORDS, MAX_REPEAT_PCT, RULES, SMOOTHING, VOTES
from pitsignal.llm.quality_rules import TOLERANCE as LIKELIHOOD_TOLERANCE

_WORD = r"[^\x20\x09-\x0D]+"


def _measures() -> str:
    return rf"""doc as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
word as (select r, i, w, lag(w) over (partition by r order by i) as before, lead(w) over (partition by r order by i) as w2,
    lead(w, 2) over (partition by r order by i) as w3
  from (select r, generate_subscripts(a, 1) as i, unnest(a) as w from (select r, regexp_extract_all(t, '{_WORD}') as a from doc))),
win as (select r, i, count(*) over (partition by r, w, w2, w3) as c from word where w3 is not null),
rep as (select r, count(distinct i + k) as n_repeat_words from win, (values (0), (1), (2)) as o(k) where c > 1 group by r),
wc as (select r, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (w = before) as n_stutter from word group by r),
line as (select r, line from (select r, unnest(string_split(t, chr(10))) as line from doc) where regexp_matches(line, '{_WORD}')),
lc as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from line group by r),
m as materialized (select r, doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, coalesce(n_stutter, 0) as n_stutter
  from doc left join wc using (r) left join lc using (r) left join rep using (r))"""


def _quality_rules() -> str:
    votes = ", ".join(f"case when {r.reject} then -1 when {r.keep} then 1 else 0 end as vote_{r.name}" for r in RULES)
    names = [f"vote_{r.name}" for r in RULES]
    ctes = [
        _measures(),
        f"v as materialized (select *, {votes} from m)",
        f"p as materialized (select {', '.join(names)}, cast(count(*) as double) as n from v group by all)",
    ]
    sums = ["(sum(n * keep) over () + {0}) / (sum(n) over () + 2 * {0}) as prior".format(SMOOTHING)]
    for r in RULES:
        for v in VOTES:
            hit = f"filter (vote_{r.name} = {v}) over ()"
            for side, part in (("k", "n * keep"), ("r", "n * (1 - keep)")):
                sums.append(f"(coalesce(sum({part}) {hit}, 0) + {SMOOTHING}) / (sum({part}) over () + 3 * {SMOOTHING}) as {side}_{r.name}_{v + 1}")
    one = lambda side: " + ".join(
        f"case vote_{r.name}" + "".join(f" when {v} then ln({side}_{r.name}_{v + 1})" for v in VOTES) + " end" for r in RULES
    )
    ctes.append(f"""f as (select 0 as k, *, case when least({', '.join(names)}) = -1 then 0.1::double else 0.9::double end as keep,
    cast(null as double) as ll, cast(null as double) as before from p
  union all
  select k + 1, {', '.join(names)}, n, 1 / (1 + exp(b - a)) as keep, sum(n * (greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))))) over () as ll, ll as before
  from (select *, ln(prior) + {one('k')} as a, ln(1 - prior) + {one('r')} as b from (select *, {', '.join(sums)} from f
    where k < {ITERATIONS} and (k < 2 or abs(ll - before) > {LIKELIHOOD_TOLERANCE} * (select sum(n) from p)))))""")
    ctes.append("q as materialized (select * from f where k = (select max(k) from f))")
    match = " and ".join(f"v.{n} = q.{n}" for n in names)
    failed = f"(v.n_words < {MIN_WORDS} or 100 * v.n_repeat_words > {MAX_REPEAT_PCT} * v.n_words)"
    return f"""with recursive {', '.join(ctes)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} as base_failed,
  not {failed} and q.keep >= 0.5 as kept, round(q.keep, 6) as posterior, {', '.join(f'v.{n}' for n in names)}
from v join q on {match}"""


QUALITY_RULES = _quality_rules()

LINE_DEDUP = rf"""with doc as materialized (select row_number() over () as r, doc_id, source, text from documents),
line as materialized (select r, source, generate_subscripts(a, 1) as i, unnest(a) as line
  from (select r, source, string_split(coalesce(text, ''), chr(10)) as a from doc)),
known as (select *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as bare, regexp_matches(line, '{_WORD}') as wordy from line),
total as (select source, count(*) as total from doc group by 1),
often as (select k.source, k.bare from known k join total t on t.source is not distinct from k.source where wordy group by 1, 2
  having count(distinct r) >= {FLOOR} and count(distinct r) > {MAX_RATIO} * any_value(t.total)),
kept as (select k.r, string_agg(k.line, chr(10) order by i) as text, count(*) as n from known k
  where not (wordy and exists (select 1 from often o where o.source is not distinct from k.source and o.bare = k.bare)) group by 1),
n as (select r, count(*) as n from line group by 1)
select doc_id, case when d.text is null then 0 else n.n end as n_lines, n.n - coalesce(kept.n, 0) as n_dropped,
  case when d.text is not null then sha256(coalesce(kept.text, '')) end as text_sha256
from doc d join n using (r) left join kept using (r)"""


# exponents that temper the token shares of sources, languages and drivers
POWERS = {"tool": 0.9, "lang": 0.9, "driver": 0.8}


def _topics() -> list[str]:
    """CTEs up to `doc` (r, doc_id, source, lang, n, topic), topics learned as in topics.learn_topics."""
    k, bins = range(topics.TOPICS), topics.BINS
    logs = ", ".join(
        f"cast(round({topics.SCALE} * ln((coalesce(sum(n) filter (topic = {t}) over (partition by bin), 0) + 1) / "
        f"(coalesce(sum(n) filter (topic = {t}) over (), 0) + {bins}))) as bigint) as l{t}"
        for t in k
    )
    best = "list_position([{0}], greatest({0})) - 1".format(", ".join(f"s{t}" for t in k))
    draw = "cast(('0x' || substr(md5('1:' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) / 4503599627370496.0"
    return [
        "raw as materialized (select row_number() over () as r, * from documents)",
        f"""wb as materialized (select r, (31 * unicode(w) + 17 * unicode(right(w, 1)) + length(w)) % {bins} as bin, count(*) as n
  from (select r, unnest(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as w from raw) group by all)""",
        f"drawn as materialized (select r from raw where {draw} < {topics.SAMPLE} / (select count(*) from raw)::double)",
        # every row has all bins, so that each round's counts exist for all of them
        f"""sb as materialized (select d.r, b.bin, coalesce(wb.n, 0) as n from (select distinct r from wb join drawn using (r)) d
  join (select unnest(range({bins})) as bin) b on true left join wb on wb.r = d.r and wb.bin = b.bin)""",
        f"""tp as (select 0 as k, r, bin, n, (first_value(bin) over (partition by r order by n desc, bin)) % {topics.TOPICS} as topic, true as moved,
    {', '.join(f'cast(0 as bigint) as l{t}' for t in k)} from sb
  union all
  select k + 1, r, bin, n, best, bool_or(best <> topic) over (), {', '.join(f'l{t}' for t in k)} from (select *, {best} as best from (
    select *, {', '.join(f'sum(n * l{t}) over (partition by r) as s{t}' for t in k)} from (
      select k, r, bin, n, topic, {logs} from tp where k < {topics.ROUNDS} and moved))))""",
        f"wt as materialized (select distinct bin, {', '.join(f'l{t}' for t in k)} from tp where k = (select max(k) from tp))",
    ]


def _mixing() -> str:
    names = {"tool": "source", "lang": "lang", "driver": "topic"}
    k = range(topics.TOPICS)
    score = ", ".join(f"sum(n * l{t}) as s{t}" for t in k)
    best = "list_position([{0}], greatest({0})) - 1".format(", ".join(f"s{t}" for t in k))
    ctes = [
        *_topics(),
        f"placed as materialized (select r, sum(n) as n, {score} from wb join wt using (bin) group by r)",
        f"doc as materialized (select r, doc_id, source, lang, coalesce(n, 0) as n, case when n is null then 'unclear' else 'topic ' || ({best}) end as topic from raw left join placed using (r))",
        "cell as materialized (select source, lang, topic, cast(sum(n) as double) as tokens from doc group by 1, 2, 3)",
    ]
    for margin, power in POWERS.items():
        c = names[margin]
        ctes.append(f"want_{c} as materialized (select {c} as value, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) over () as share from cell group by 1)")
    step, wants = "fit", []
    for c in names.values():
        wants.append(f"join want_{c} t_{c} on t_{c}.value is not distinct from cell.{c}")
        step = f"select * replace (case when sum(w) over (partition by {c}) > 0 then w * want_{c} / sum(w) over (partition by {c}) else 0 end as w) from ({step})"
        if "from (fit)" in step:
            step = step.replace("from (fit)", f"from fit where k < {ROUNDS} and (k % {LAZY_ROUNDS} <> 0 or off > {TOLERANCE})")
    offs = ", ".join(f"abs(sum(w) over (partition by {c}) - want_{c})" for c in names.values())
    shares = ", ".join(f"t_{c}.share as want_{c}" for c in names.values())
    kept = ", ".join(f"want_{c}" for c in names.values())
    ctes.append(
        f"""fit as (select 0 as k, source, lang, topic, tokens, tokens as w, {shares}, cast(1 as double) as off from cell {' '.join(wants)}
  union all
  select k + 1, source, lang, topic, tokens, w, {kept}, max(e) over () from (select *, greatest({offs}) as e from ({step})))"""
    )
    draw = "cast(('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) / 4503599627370496.0"
    return f"""with recursive {', '.join(ctes)},
rate as materialized (select source, lang, topic, off, w / sum(w) over () as weight, coalesce((case when tokens > 0 then w / tokens end)
  / max(case when tokens > 0 then w / tokens end) over (), 1.0) as p from fit where k = (select max(k) from fit))
select doc_id, d.source, d.lang, d.topic, round(weight, 9) as weight, round(p, 9) as probability, round(off, 5) as margin_error, {draw} < p as sampled
from doc d join rate r on d.source is not distinct from r.source and d.lang is not distinct from r.lang and d.topic = r.topic"""


MIXING = _mixing()


MERKLE_LEVELS = 40  # of a language: up to a trillion rows
LANG_LEVELS = 12


def _climb(name: str, levels: int) -> list[str]:
    """CTEs of the nodes (grp, pos, d, m = nodes of the level) from {name}0 up."""
    return [
        f"{name}{k + 1} as materialized (select grp, pos // 2 as pos, case when any_value(m) = 1 then min(d) else sha256(string_agg(d, '' order by pos)) end as d, "
        f"(any_value(m) + 1) // 2 as m from {name}{k} group by grp, pos // 2)"
        for k in range(levels)
    ]


def _fold(name: str, source: str, nodes: str, levels: int) -> list[str]:
    """CTEs {name}1 and on that take each row of {source} (r, grp, pos, siblings, shown) one level up."""
    out, last = [], source
    for k in range(levels):
        out.append(
            f"{name}{k + 1} as materialized (select f.r, f.grp, f.pos // 2 as pos, siblings || coalesce(s.d, '') as siblings, case when own.m = 1 then shown "
            f"when f.pos % 2 = 0 then sha256(shown || coalesce(s.d, '')) else sha256(s.d || shown) end as shown "
            f"from {last} f join {nodes}{k} own on own.grp = f.grp and own.pos = f.pos "
            f"left join {nodes}{k} s on s.grp = f.grp and s.pos = xor(f.pos, 1))"
        )
        last = f"{name}{k + 1}"
    return out


def _merkle() -> str:
    def leaf(n_chars: str) -> str:
        values = [f"cast({v} as varchar)" for v in ("doc_id", "source", "lang", n_chars, "text")]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    crc = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [cast(0 as bigint), 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)), 4294967295)"""
    ctes = [
        f"doc as materialized (select row_number() over () as r, doc_id, coalesce('=' || lang, '-') as grp, {leaf('n_chars')} as leaf, "
        f"case when {crc} % 7 = 0 then {leaf('(n_chars + 1)')} else {leaf('n_chars')} end as shown from documents)",
        "ord as materialized (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as pos from doc)",
        "n0 as materialized (select grp, pos, leaf as d, count(*) over (partition by grp) as m from ord)",
        *_climb("n", MERKLE_LEVELS),
        f"top as materialized (select grp, d as subroot, row_number() over (order by encode(grp)) - 1 as place from n{MERKLE_LEVELS})",
        "g0 as materialized (select 0 as grp, place as pos, subroot as d, count(*) over () as m from top)",
        *_climb("g", LANG_LEVELS),
        "start as materialized (select r, grp, pos, '' as siblings, shown from ord)",
        *_fold("up", "start", "n", MERKLE_LEVELS),
        f"over as materialized (select f.r, 0 as grp, t.place as pos, siblings, shown from up{MERKLE_LEVELS} f join top t on t.grp = f.grp)",
        *_fold("out", "over", "g", LANG_LEVELS),
    ]
    return f"""with {', '.join(ctes)}
select doc_id, leaf, subroot, root, sha256(siblings) as proof_sha256, f.shown as folded_root, f.shown = root as verified
from doc d join top t on t.grp = d.grp join out{LANG_LEVELS} f using (r), (select d as root from g{LANG_LEVELS})"""


MERKLE = _merkle()
