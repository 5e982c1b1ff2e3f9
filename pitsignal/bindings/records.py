"""Decisions, evidence, ledger, audit and text functions on the test tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.bindings.base import BROKER_SQL, DECISIONS_SQL, ORDERS_SQL, TRANSITIONS_SQL, for_oracle, for_spark, load, query, r
from pitsignal.bindings.options import _ORDER, APPROVED, CTE_FEAS, POLICY, now, thin_chain
from pitsignal.functions import text as tx
from pitsignal.functions.contracts import direction
from pitsignal.operators import decisions as dec
from pitsignal.operators import ledger, risk, spreads
from pitsignal.operators.ledger_store import LedgerStore
from pitsignal.operators.ordering import with_previous
from pitsignal.plans import audit
from pitsignal.schemas import LEDGER
from pitsignal.session import scratch_path

# recorded replies with every kind of defect; one text for both dialects
REPLIES_SQL = """
select event_id, case
 when event_id % 17 = 0 then null
 when event_id % 17 = 1 then '{{"action": "continuation", "confidence": 0.5'
 when event_id % 17 = 2 then '{{"action": "continuation", "confidence": 0.5, "driver": "macro", "reason": "r"}}'
 when event_id % 17 = 3 then '[1, 2]'
 when event_id % 17 = 4 then '{{"action": "continuation", "confidence": 1.5, "driver": "macro", "idiosyncratic_news_detected": false, "reason": "r"}}'
 when event_id % 17 = 5 then '{{"action": "hold", "confidence": 0.5, "driver": "macro", "idiosyncratic_news_detected": false, "reason": "r"}}'
 when event_id % 17 = 6 then '{{"action": "reversion", "confidence": 0.5, "driver": "macro", "idiosyncratic_news_detected": false, "reason": ""}}'
 when event_id % 17 = 7 then '{{"action": "reversion", "confidence": 0.5, "driver": "macro", "idiosyncratic_news_detected": false, "reason": "r", "x": 1}}'
 else concat('{{"action": "', case event_type when 'click' then 'continuation' when 'view' then 'continuation' when 'purchase' then 'reversion' else 'abstain' end,
  '", "confidence": 0.', lpad(cast(event_id % 100 as varchar(5)), 2, '0'), ', "driver": "', case when event_id % 4 = 0 then 'crypto_cross_market' when event_id % 4 = 2 then 'macro' else 'unclear' end,
  '", "idiosyncratic_news_detected": ', case when event_id % 5 = 1 then 'true' else 'false' end, ', "reason": "r', cast(event_id % 3 as varchar(5)), '"}}') end as content
from {events}
"""

CTE_PARSED = """parsed0 as (select event_id, event_type, case when event_id % 17 = 0 then 'non_text_response' when event_id % 17 = 1 then 'malformed_json'
  when event_id % 17 in (2, 3, 7) then 'invalid_response_shape' when event_id % 17 in (4, 5, 6) then 'schema_validation' end as code, event_id % 5 = 1 as news from events),
parsed as (select event_id, code, case when code is not null or news then 'abstain' when event_type in ('click', 'view') then 'continuation' when event_type = 'purchase' then 'reversion' else 'abstain' end as action,
  case when code is null then (event_id % 100)/100.0 else 0 end as confidence, code is null and news as flag,
  case when code is not null then 'unclear' when news then 'company_specific' when event_id % 4 = 0 then 'crypto_cross_market' when event_id % 4 = 2 then 'macro' else 'unclear' end as driver,
  case when code is not null then 'fail_closed:' || code else 'r' || (event_id % 3) end as reason from parsed0)"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = spark.sql(REPLIES_SQL, events=load(spark, sf_dir, "events"))
    return dec.parse_decisions(replies)


@query("P25_decision_parse", f"with {CTE_PARSED} select event_id, code as failure_code, action, confidence::double as confidence, flag as idiosyncratic_news_detected, driver, reason from parsed")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).drop("content")


_DEC = f"dec as ({for_oracle(DECISIONS_SQL)})"


@query("P26_decision_normalise", f"""with {_DEC} select event_id, case when idiosyncratic_news_detected then 'abstain' else action end as action,
 case when idiosyncratic_news_detected then 'company_specific' else driver end as driver from dec""")
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.normalize_decisions(for_spark(spark, sf_dir, DECISIONS_SQL)).select("event_id", "action", "driver")


@query("J16_decision_agreement", f"""with {_DEC}, {CTE_PARSED} select p.event_id, case when code is null then 'ok' else 'invalid' end as status,
 case when code is null then p.action = d.action end as action_agreement, case when code is null then p.driver = d.driver end as driver_agreement,
 case when code is null then p.flag = d.idiosyncratic_news_detected end as idiosyncratic_news_agreement, coalesce(code, 'observed') as reason from parsed p join dec d using (event_id)""")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.agreement(parsed(spark, sf_dir), for_spark(spark, sf_dir, DECISIONS_SQL), "event_id")


def _m(cond: str) -> str:
    return f"count(*) filter (where {cond})"


_SHARES = f"""{r('greatest(' + ', '.join(_m(f"action = '{a}'") for a in dec.ACTIONS) + ')/count(*)')} as action_consistency,
 {r('greatest(' + ', '.join(_m(f"driver = '{a}'") for a in dec.DRIVERS) + ')/count(*)')} as driver_consistency,
 {r('greatest(' + _m('idiosyncratic_news_detected') + ', ' + _m('not idiosyncratic_news_detected') + ')/count(*)')} as idiosyncratic_consistency"""


def _pairs(column: str, values: tuple[str, ...]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {_m(f"{column} = '{v}'")} > 0 then concat('{v}=', {_m(f"{column} = '{v}'")}) end" for v in sorted(values)) + ")"


_PROFILE = f"""scenario, count(*) as count, {_pairs('action', dec.ACTIONS)} as actions, {_pairs('driver', dec.DRIVERS)} as drivers,
 concat('false=', {_m('not idiosyncratic_news_detected')}, ',true=', {_m('idiosyncratic_news_detected')}) as idiosyncratic_news_detected, {_SHARES},
 {_m("action = 'abstain' and reason like 'fail_closed:%'")} as fail_closed_count, {r(_m("action = 'abstain' and reason like 'fail_closed:%'") + '/count(*)')} as fail_closed_rate,
 {r('min(confidence)')} as confidence_min, {r('avg(confidence)')} as confidence_mean, {r('max(confidence)')} as confidence_max,
 {r(_m("action = 'continuation'") + '/count(*)')} as expected_action_rate, {r(_m('not idiosyncratic_news_detected') + '/count(*)')} as expected_idiosyncratic_rate, count(distinct reason) as unique_reason_count"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.decision_profile(for_spark(spark, sf_dir, DECISIONS_SQL), ["scenario"], expected_action="continuation", expected_idiosyncratic=False)


@query("A20_decision_consistency", f"with {_DEC} select scenario, {_SHARES} from dec group by scenario")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir).select("scenario", "action_consistency", "driver_consistency", "idiosyncratic_consistency")


@query("A21_decision_profile", f"with {_DEC} select {_PROFILE} from dec group by scenario")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, sf_dir)


@query("C06_decision_reproducibility", f"with {CTE_PARSED}, dec as (select event_id % 40 as scenario, action, driver, flag as idiosyncratic_news_detected, confidence, reason from parsed) select {_PROFILE} from dec group by scenario")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = parsed(spark, sf_dir).withColumn("scenario", F.col("event_id") % 40)
    return dec.decision_profile(table, ["scenario"], expected_action="continuation", expected_idiosyncratic=False)


# ---------------------------------------------------------------- evidence and text

TOOLS = ("view", "click", "purchase")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    k = F.get_json_object("props", "$.k")
    return load(spark, sf_dir, "events").select(
        c("user_id").alias("episode_id"),
        c("event_id").alias("call_no"),
        c("event_type").alias("tool"),
        F.concat(F.lit('{"symbol": "S", "api_key": "a", "nested": {"access_token": "b", "safe": '), k, F.lit("}}")).alias("arguments_json"),
        F.when(c("event_id") % 7 != 0, F.concat(F.lit('{"z": '), k, F.lit(', "a": {"y": "é", "b": '), c("event_id").cast("string"), F.lit("}}"))).alias("result_json"),
    )


_EV = """ev as (select user_id as episode_id, event_id as call_no, event_type as tool, concat('{"api_key":"[REDACTED]","nested":{"access_token":"[REDACTED]","safe":', props->>'k', '},"symbol":"S"}') as arguments_json,
 event_type in ('view', 'click', 'purchase') as allowed, event_id % 7 <> 0 as fine, concat('{"a":{"b":', event_id, ',"y":"\\u00e9"},"z":', props->>'k', '}') as result from events)"""


@query("S14_tool_evidence", f"""with {_EV} select episode_id, call_no, tool, arguments_json, allowed and fine as success,
 case when not allowed then 'tool_not_allowed' when not fine then 'tool_failure' end as error_code, case when allowed and fine then sha256(result) else '' end as result_sha256 from ev""")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.tool_evidence(tool_calls(spark, sf_dir), TOOLS)


@query("S14_evidence_complete", f"with {_EV}, s as (select call_no - call_no % 2 as episode_id, bool_and(allowed and fine) as ok from ev group by 1) select distinct c_custkey as episode_id, coalesce(ok, false) as complete from customer left join s on s.episode_id = c_custkey")
def s14_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = dec.tool_evidence(tool_calls(spark, sf_dir).withColumn("episode_id", F.expr("call_no - call_no % 2")), TOOLS)
    return dec.evidence_complete(evidence, load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_id")))


@query("F04_canonical_digests", """select p_partkey, concat('desk-', substr(sha256(concat('{"debit":"', (p_size + 0.25)::decimal(18,2), '","episode_id":"', p_partkey, '","expiration":"2026-09-18","long":"', p_brand,
 '","short":"', p_type, '","underlying":"', p_name, '"}')), 1, 32)) as open_id, concat('desk-close-', substr(sha256(concat('{"attempt":', p_partkey % 2, ',"episode_id":"', p_partkey, '","phase":"close"}')), 1, 28)) as close_id from part""")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        tx.open_order_id(
            "desk", episode_id=c("p_partkey"), underlying=c("p_name"), expiration=F.lit("2026-09-18"), long=c("p_brand"), short=c("p_type"),
            debit=(c("p_size") + F.lit(Decimal("0.25"))).cast("decimal(18,2)"),
        ).alias("open_id"),
        tx.close_order_id("desk", episode_id=c("p_partkey"), attempt=c("p_partkey") % 2).alias("close_id"),
    )


@query("F05_key_redaction", """select event_id, concat('{"api_key":"[REDACTED]","nested":{"access_token":"[REDACTED]","safe":', props->>'k', '},"rows":[{"secret":"[REDACTED]","v":', event_id, '}]}') as redacted,
 concat('{"nested":{"safe":', props->>'k', '},"price":', (event_id % 50)::varchar, '.25,"rows":[{"v":', event_id, '}]}') as public from events""")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    nested = F.concat(F.lit('"nested": {"safe": '), k, F.lit(', "access_token": "t"}, "rows": [{"v": '), e, F.lit(', "secret": 1}]'))
    return load(spark, sf_dir, "events").select(
        "event_id",
        tx.redact_json(F.concat(F.lit('{"api_key": {"deep": 1}, '), nested, F.lit("}"))).alias("redacted"),
        tx.public_json(F.concat(F.lit('{"api_key": {"deep": 1}, "price": '), (F.col("event_id") % 50).cast("string"), F.lit(".2501, "), nested, F.lit("}"))).alias("public"),
    )


@query("F06_secret_scan", """with t as (select doc_id, regexp_replace(text, ' (token = )', chr(10) || '\\1', 'g') as text from documents),
 l as (select doc_id, unnest(string_split(text, chr(10))) as line from t),
 v as (select doc_id, trim(regexp_extract(line, '^[ \\t]*token[ \\t]*=([^#\\r]*)', 1), ' ' || chr(9)) as v from l where regexp_matches(line, '^[ \\t]*token[ \\t]*=[ \\t]*[^#\\r]*$'))
 select distinct doc_id, 'assigned:token' as finding from v where trim(v, '"''') <> '' union
 select doc_id, 'token_shape' from t where regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{20,}\\b') union select doc_id, 'value_in_use' from t where contains(text, 'disgusting')""")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.regexp_replace("text", " (token = )", "\n$1")
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(tx.secret_findings(lines, ["token"], ["disgusting"])).alias("finding"))


@query("F07_context_digest", """with e as (select conv_id, turn, concat('"', array_to_string(list_transform(string_split(text, ''), lambda c: case when c = '"' then '\\"' when c = '\\' then '\\\\' when c = chr(10) then '\\n'
  when c = chr(13) then '\\r' when c = chr(9) then '\\t' when unicode(c) > 127 then printf('\\u%04x', unicode(c)) else c end), ''), '"') as j from conversations where role = 'assistant')
 select conv_id, substr(concat('[', string_agg(j, ',' order by turn), ']'), 1, 1600) as digest from e group by 1""")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    return dec.context_digest(heard, ["conv_id"], "turn", "text")


@query("F07_tool_digest", f"""with {_EV} select episode_id, substr(concat('[', string_agg(result, ',' order by call_no), ']'), 1, 1600) as digest from ev where tool = 'view' and fine group by 1""")
def f07_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dec.tool_digest(tool_calls(spark, sf_dir), "view")


# ---------------------------------------------------------------- ledger

TERMINAL = ("signup", "error")
# stand-in for the legal-transition table over the event types
STEPS = {"view": ("click", "purchase"), "click": ("purchase", "signup", "error"), "purchase": ("view", "signup"), "signup": (), "error": ()}


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.when(F.col("transition_id") % 3 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"reason": "r'), (F.col("transition_id") % 5).cast("string"), F.lit('"}')))
    events = load(spark, sf_dir, "events")
    named = events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("transition_id"), F.col("event_type").alias("to_state"), F.col("ts").cast("timestamp").alias("created_at"))
    # the state before by id ranges: a user with any number of events is many tasks
    table = with_previous(named, ["episode_id"], "transition_id", "to_state", "from_state")
    return table.withColumn("payload_json", payload).withColumn("event", F.lit("step"))


def ledger_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return steps.groupBy(F.col("user_id").alias("episode_id")).agg(
        F.to_date(F.min("ts")).alias("session_date"),
        F.concat(F.lit("U"), (F.first("user_id") % 20).cast("string")).alias("underlying"),
        F.max_by("event_type", "event_id").alias("state"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_spark(spark, sf_dir, ORDERS_SQL)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("mark_id"), F.col("user_id").alias("episode_id"), F.col("ts").cast("timestamp").alias("marked_at"),
        F.col("event_type").alias("value"), F.col("props").alias("payload_json"),
    )


_TR = f"tr as ({for_oracle(TRANSITIONS_SQL)})"
_EPS = """eps as (select user_id as episode_id, min(ts)::date as session_date, 'U' || (user_id % 20) as underlying, max_by(event_type, event_id) as state, min(ts) as created_at, max(ts) as updated_at from events group by user_id)"""
_ORD = f"ord as ({for_oracle(ORDERS_SQL)})"
_BRK = f"brk as ({for_oracle(BROKER_SQL)})"


@query("S11_ledger_tables", """select 'agent_decisions' as table_name, count(*) as row_count from events union all select 'episodes', (select count(*) from (select distinct d, u from (select min(ts)::date as d, user_id % 20 as u from events group by user_id))) union all select 'features', count(*) from events
 union all select 'marks', count(*) from events union all select 'orders', count(*) from orders union all select 'risk_decisions', count(*) from events union all select 'transitions', count(*) from events""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ledger")
    events = load(spark, sf_dir, "events")
    single = events.select(F.col("event_id").alias("episode_id"), F.col("props").alias("payload_json"), F.col("ts").alias("created_at"))
    orders = ledger_orders(spark, sf_dir).select(
        "order_id", "episode_id", F.concat(F.lit("c"), "order_id").alias("client_order_id"), F.lit(None).cast("string").alias("broker_order_id"), "status",
        F.lit("{}").alias("payload_json"), "created_at", F.col("created_at").alias("updated_at"),
    )
    tables = {
        "episodes": ledger_episodes(spark, sf_dir), "transitions": transitions(spark, sf_dir), "features": single, "agent_decisions": single, "risk_decisions": single,
        "orders": orders, "marks": marks(spark, sf_dir),
    }
    store = LedgerStore(spark, path, buckets=8)
    for name, df in tables.items():
        store.insert(name, df, commit="first")
        # the same rows once more, as after a lost acknowledgement, leave the table as it is
        store.insert(name, df, commit="again")
    return ledger.row_counts({name: store.read(name) for name in LEDGER})


@query("A25_row_counts", "select 'episodes' as table_name, count(distinct user_id) as row_count from events union all select 'orders', count(*) from orders union all select 'marks', count(*) from events")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.row_counts({"episodes": ledger_episodes(spark, sf_dir), "orders": ledger_orders(spark, sf_dir), "marks": marks(spark, sf_dir)})


@query("S12_insert_once", """select ts::date::varchar as session_date, user_id, min(event_id) as event_id from events e where (ts::date, user_id) not in
 (select (ts::date, user_id) from events where event_id % 29 = 0) group by 1, 2""")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.to_date("ts").alias("session_date"), "user_id", "event_id")
    return ledger.insert_once(rows.where("event_id % 29 = 0"), rows, keys=["session_date", "user_id"], order="event_id")


_UPD = """upd as (select l_orderkey + (case when l_orderkey % 97 = 0 then 1000000000 else 0 end) as id, l_linenumber as no, l_linestatus as status, case when l_linenumber % 2 = 0 then 'b' || l_suppkey end as broker,
 '{"q":' || l_quantity::int || '}' as payload, row(l_linenumber, l_partkey, l_suppkey, l_quantity) as pk from lineitem),
agg as (select id, max_by(status, pk) as status, max_by(payload, pk) as payload, max_by(broker, pk) filter (where broker is not null) as broker from upd group by 1)"""


@query("S13_order_update", f"""with {_UPD}, o as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'old' || o_custkey end as broker, o_orderstatus as status from orders)
 select coalesce(o.id, a.id) as client_order_id, coalesce(a.broker, o.broker) as broker_order_id, case when a.id is not null then a.status else o.status end as status,
 case when a.id is not null then a.payload else '{{}}' end as payload_json, o.id is null as unknown from o full join agg a on a.id = o.id""")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    orders = load(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("client_order_id"), F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("old"), "o_custkey")).alias("broker_order_id"),
        c("o_orderstatus").alias("status"), F.lit("{}").alias("payload_json"),
    )
    updates = load(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") + F.when(c("l_orderkey") % 97 == 0, 1000000000).otherwise(0)).alias("client_order_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("update_no"),
        c("l_linestatus").alias("status"),
        F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("b"), "l_suppkey")).alias("broker_order_id"),
        F.concat(F.lit('{"q":'), c("l_quantity").cast("int"), F.lit("}")).alias("payload_json"),
    )
    return ledger.update_orders(orders, updates)


_LATEST = """select * from (select 'order' as kind, episode_id, '' as part, max(order_id) as id from ord group by 2 union all select 'phase', episode_id, phase, max(order_id) from ord group by 2, 3
 union all select 'mark', user_id, event_type, max(event_id) from events group by 2, 3)"""


@query("W08_latest_rows", f"with {_ORD} {_LATEST}")
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, empty = ledger_orders(spark, sf_dir), F.lit("")
    shape = lambda df, kind, part, id_: df.select(F.lit(kind).alias("kind"), "episode_id", part.alias("part"), F.col(id_).alias("id"))
    return (
        shape(ledger.latest_per(orders, ["episode_id"], "order_id"), "order", empty, "order_id")
        .unionByName(shape(ledger.latest_per(orders, ["episode_id", "phase"], "order_id"), "phase", F.col("phase"), "order_id"))
        .unionByName(shape(ledger.latest_per(marks(spark, sf_dir), ["episode_id", "value"], "mark_id"), "mark", F.col("value"), "mark_id"))
    )


_LEGAL = "(" + ", ".join(f"'{a}>{b}'" for a, t in STEPS.items() for b in t) + ")"


@query("W09_state_path_audit", f"""with {_TR}, p as (select *, lag(to_state) over (partition by episode_id order by transition_id) as prev from tr)
 select episode_id, transition_id, from_state, to_state, from_state is not null and from_state <> to_state and from_state || '>' || to_state not in {_LEGAL} as illegal_step,
 coalesce(prev <> from_state, false) as broken_chain, coalesce(prev in ('signup', 'error'), false) as left_terminal from p""")
def w09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.audit_paths(transitions(spark, sf_dir), STEPS)


@query("W10_current_state", "select user_id as episode_id, max_by(event_type, event_id) as state, max(event_id) as last_transition_id from events group by 1")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current_state(transitions(spark, sf_dir))


@query("J15_order_reconciliation", f"""with {_ORD}, {_BRK}, b as (select order_id, case return_flag when 'A' then 'filled' when 'N' then 'canceled' else case when line_status = 'O' then 'rejected' else 'partially_filled' end end as st from brk)
 select o.order_id, o.episode_id, coalesce(st, 'indeterminate') as reconciled_status, case st when 'filled' then 'MONITORING' when 'canceled' then 'CLOSED' when 'rejected' then 'CLOSED' else 'ORDER_SUBMITTED' end as next_state,
 st is not null as reconciled from ord o left join b using (order_id)""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    broker = for_spark(spark, sf_dir, BROKER_SQL)
    status = F.when(c("return_flag") == "A", "FILLED").when(c("return_flag") == "N", "canceled").when(c("line_status") == "O", "rejected").otherwise("partially_filled")
    orders = ledger_orders(spark, sf_dir).select("order_id", "episode_id")
    return ledger.reconcile(orders, broker.select("order_id", status.alias("broker_status")), key="order_id")


_REASON = "rsn as (select user_id as episode_id, max_by(event_id, event_id) as id from events where event_type = 'error' group by 1)"
_REASON_COL = "case when rsn.id % 3 <> 0 then 'r' || (rsn.id % 5) end as reason"


@query("J17_latest_abstain_reason", f"with {_EPS}, {_REASON} select e.episode_id, e.underlying, e.state, {_REASON_COL} from eps e left join rsn using (episode_id)")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_latest_reason(ledger_episodes(spark, sf_dir), transitions(spark, sf_dir), "error").select("episode_id", "underlying", "state", "reason")


@query("J18_startable_sessions", f"""with {_EPS}, req as (select o_orderkey, 'U' || (o_custkey % 20) as underlying, date '2024-01-01' + (o_orderkey % 3)::int as session_date from orders)
 select o_orderkey, underlying, session_date::varchar as session_date from req r where not exists (select 1 from eps e where e.underlying = r.underlying and e.state not in ('signup', 'error') and e.session_date < r.session_date)""")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("U"), (F.col("o_custkey") % 20).cast("string")).alias("underlying"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 3).cast("int")).alias("session_date"),
    )
    return ledger.startable_sessions(requests, ledger_episodes(spark, sf_dir), TERMINAL)


@query("T04_latest_episodes", f"with {_EPS} select episode_id, session_date::varchar as session_date, underlying, state from eps order by eps.session_date desc, created_at desc, episode_id desc limit 20")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_episodes(ledger_episodes(spark, sf_dir), 20).select("episode_id", "session_date", "underlying", "state")


@query("T05_oldest_unresolved", f"""with {_EPS} select underlying, episode_id, session_date::varchar as session_date, state from (select *, row_number() over (partition by underlying order by session_date, created_at, episode_id) as rn
 from eps where state not in ('signup', 'error')) where rn = 1""")
def t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.oldest_unresolved(ledger_episodes(spark, sf_dir), TERMINAL).select("underlying", "episode_id", "session_date", "state")


@query("T06_orders_in_sequence", f"with {_ORD} select order_id, episode_id, row_number() over (partition by episode_id order by order_id) as sequence_no from ord")
def t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.orders_in_sequence(ledger_orders(spark, sf_dir)).select("order_id", "episode_id", "sequence_no")


@query("C10_episode_audit_view", f"""with {_EPS}, {_REASON}, {_ORD}, lo as (select episode_id, max(order_id) as order_id, max_by(status, order_id) as order_status from ord group by 1),
 mk as (select user_id as episode_id, max_by(props, event_id) filter (where event_type = 'view') as mark_view, max_by(props, event_id) filter (where event_type = 'click') as mark_click from events group by 1)
 select e.episode_id, e.session_date::varchar as session_date, e.underlying, e.state, strftime(e.updated_at, '%Y-%m-%d %H:%M:%S') as updated_at, {_REASON_COL}, lo.order_id, lo.order_status, mark_view, mark_click
 from (select * from eps order by session_date desc, created_at desc, episode_id desc limit 50) e left join rsn using (episode_id) left join lo using (episode_id) left join mk using (episode_id)""")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = audit.episode_view(
        ledger_episodes(spark, sf_dir), transitions(spark, sf_dir), ledger_orders(spark, sf_dir), marks(spark, sf_dir),
        limit=50, abstain_state="error", mark_kinds=("view", "click"),
    )
    return view.drop("created_at")


# ---------------------------------------------------------------- set operations

@query("U02_date_intersection", "select ts::date::varchar as session_date from events where event_type = 'purchase' intersect select (ts::date + 1)::varchar from events where event_type = 'click'")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    days = lambda kind, later: events.where(F.col("event_type") == kind).select(F.date_add(F.to_date("ts"), later).alias("session_date"))
    return days("purchase", 0).intersect(days("click", 1))


@query("U03_distinct_expirations", """with d as (select distinct p_brand, 5 + p_size % 20 as dte from part) select p_brand, dte::bigint as dte, row_number() over (partition by p_brand order by dte) as position from d""")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    distinct = load(spark, sf_dir, "part").select("p_brand", (5 + F.col("p_size") % 20).alias("dte")).distinct()
    return distinct.withColumn("position", F.row_number().over(Window.partitionBy("p_brand").orderBy("dte")))


@query("U04_open_episodes", f"with {_EPS} select episode_id, state from eps except select episode_id, state from eps where state in ('signup', 'error')")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unresolved(ledger_episodes(spark, sf_dir), TERMINAL).select("episode_id", "state")


# ---------------------------------------------------------------- gate funnel

FUNNEL_RISK = risk.RiskPolicy(approved=APPROVED)


def funnel_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode per event: features, chain feasibility, recorded reply, candidate under its budget, risk."""
    c = F.col
    e = c("event_id")
    base = load(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("Brand#"), (e % 25).cast("string"), F.lit("/0")).alias("chain_id"),
        F.concat(F.lit("Brand#"), (e % 25).cast("string")).alias("underlying"),
        (e % 19 != 0).alias("has_features"),
        F.when(e % 23 != 0, c("value") / 1000).alias("opening_return"),
        ((e % 41).cast("double") / 100 - 0.2).alias("residual"),
        F.lit(0.01).alias("threshold"),
        (e % 13 != 0).alias("evidence_complete"),
        F.lit(Decimal("200000")).cast("decimal(18,2)").alias("starting_equity"),
        F.lit(Decimal("5000")).cast("decimal(18,2)").alias("buying_power"),
        ((e % 12) * 1000).cast("decimal(18,2)").alias("aggregate_defined_loss"),
        F.when(e % 6 == 0, F.array(F.concat(F.lit("Brand#"), (e % 25).cast("string")))).otherwise(F.array().cast("array<string>")).alias("open_underlyings"),
        now().alias("now"),
    )
    chain = thin_chain(spark, sf_dir)
    feasible = spreads.feasibility(chain, ["chain_id"], POLICY, now()).select("chain_id", "feasible", c("reason").alias("feasibility_reason"))
    decided = parsed(spark, sf_dir).select("event_id", "action", c("reason").alias("decision_reason"))
    sided = (
        base.join(feasible, "chain_id", "left")
        .join(decided, "event_id")
        .withColumn("direction", direction(c("action"), F.signum("residual").cast("int")))
        .withColumn("max_net_debit", risk.debit_budget(FUNNEL_RISK))
    )
    # many episodes share a chain and a budget: construct once per distinct request
    requests = base.select("chain_id", risk.debit_budget(FUNNEL_RISK).alias("max_net_debit")).where("max_net_debit > 0").distinct()
    within = spreads.best_verticals(
        chain.join(requests.withColumn("budget", c("max_net_debit")), "chain_id"), ["chain_id", "max_net_debit"], POLICY, now(), "budget"
    )
    candidate = within.select("chain_id", "max_net_debit", "direction", "long_symbol", "short_symbol", "max_loss", "quote_ts")
    joined = sided.join(candidate, ["chain_id", "max_net_debit", "direction"], "left")
    return joined.withColumn("risk_reasons", risk.risk_reasons(FUNNEL_RISK, c("now")))


_FUNNEL = f"""with {CTE_FEAS}, {CTE_PARSED}, ep as (select event_id, 'Brand#' || (event_id % 25) || '/0' as chain_id, 'Brand#' || (event_id % 25) as underlying, event_id % 19 <> 0 as hf, event_id % 23 <> 0 as ho,
  (event_id % 41)::double/100 - 0.2 as residual, event_id % 13 <> 0 as ec, (event_id % 12)*1000 as agg, event_id % 6 = 0 as held from events),
bud as (select *, greatest(least(2000, 10000 - agg, 5000), 0)/100.0 as budget from ep),
dd as (select b.*, p.action, p.reason as dreason, case p.action when 'continuation' then sign(residual) when 'reversion' then -sign(residual) end as eff from bud b join parsed p using (event_id)),
reqs as (select distinct chain_id, budget from bud where budget > 0),
cands as (select * from (select p.*, q.budget, row_number() over (partition by p.chain_id, q.budget, option_type order by {_ORDER}) as rn from pairs p join reqs q on q.chain_id = p.chain_id and p.debit <= q.budget) where rn = 1),
rk as (select d.*, f.reason as freason, f.chain_id is not null as hasf, c.ls, c.ss, round(c.debit, 2)*100 as ml, concat_ws(',', case when held then 'underlying_already_open' end, case when agg + round(c.debit, 2)*100 > 10000 then 'aggregate_loss_cap' end) as rr
  from dd d left join feas f using (chain_id) left join cands c on c.chain_id = d.chain_id and c.budget = d.budget and c.option_type = case d.eff when 1 then 'call' when -1 then 'put' end),
out as (select *, case when not hf then 'premarket_features_unavailable' when not ho then 'opening_confirmation_unavailable' when abs(residual) < 0.01 then 'residual_below_frozen_threshold'
  when freason is not null then freason when not hasf then 'option_surface_unavailable' when not ec then 'tool_context_unavailable' when residual = 0 then 'zero_residual' when action = 'abstain' then dreason
  when budget <= 0 then 'risk_budget_exhausted' when ls is null then 'no_constructible_vertical' when rr <> '' then split_part(rr, ',', 1) end as stop from rk)"""


@query("C08_gate_funnel", f"{_FUNNEL} select event_id, case when stop is null then 'RISK_APPROVED' else 'ABSTAINED' end as state, coalesce(stop, 'dry_run_would_submit') as reason from out")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gate_funnel(funnel_inputs(spark, sf_dir)).select("event_id", "state", "reason")


@query("C08_funnel_counts", f"{_FUNNEL} select case when stop is null then 'RISK_APPROVED' else 'ABSTAINED' end as state, coalesce(stop, 'dry_run_would_submit') as reason, count(*) as episode_count from out group by 1, 2")
def c08_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.funnel_counts(audit.gate_funnel(funnel_inputs(spark, sf_dir)))
