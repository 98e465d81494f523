"""Named queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# Shared SQL: the orders forest and the sequences, as tables.py builds them.
SEQ = "translate(md5(cast({} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
REF = "translate(md5('ref'), '0123456789abcdef', 'ACGTACGTACGTACGT')"
FOREST = """
le as (select l_orderkey ok, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end cl,
              cast(l_quantity as bigint) w, cast(l_linenumber as bigint) ln from lineitem),
lc as (select ok, cl, min(w) cw, max(w) cx, count(*) n from le group by ok, cl),
ob as (select ok, cast(sum(cw) as bigint) ow, cast(sum(cx) as bigint) ox,
              list_reduce(list(n), lambda a, b: a * b) n from lc group by ok),
oe as (select o_custkey ck, o_orderkey ok, cast(substr(o_orderpriority, 1, 1) as int) - 1 cl,
              ow + 1 w, ox + 1 x, n from orders join ob on ob.ok = o_orderkey),
oc as (select ck, cl, min(w) cw, max(x) cx, sum(n) n from oe group by ck, cl),
ct as (select ck, cast(sum(cw) as bigint) tot, cast(sum(cx) as bigint) tox,
              list_reduce(list(cast(n as bigint)), lambda a, b: a * b) n from oc group by ck)
"""
GROUPS = """
g as (
  select n_regionkey rk, c_nationkey nk, 'A' t, c_mktsegment grp, c_custkey k from customer join nation on n_nationkey = c_nationkey
  union all select n_regionkey, c_nationkey, 'B', cast(c_custkey % 5 as varchar), c_custkey from customer join nation on n_nationkey = c_nationkey
  union all select n_regionkey, c_nationkey, 'C', cast(cast(floor(c_acctbal / 2500) as bigint) as varchar), c_custkey from customer join nation on n_nationkey = c_nationkey
  union all select n_regionkey, c_nationkey, 'D', case when c_mktsegment = 'BUILDING' then 'x' else c_mktsegment end, c_custkey from customer join nation on n_nationkey = c_nationkey),
cl as (select rk, nk, t, grp, md5(string_agg(cast(k as varchar), ',' order by k)) key, count(*) sz from g group by rk, nk, t, grp),
nv as (select rk, nk, t, sum(sz) sz, md5(string_agg(key, ',' order by key)) split from cl group by rk, nk, t),
rv as (select rk, t, sum(sz) sz, md5(string_agg(cast(nk as varchar), ',' order by nk)) split from nv group by rk, t)
"""
