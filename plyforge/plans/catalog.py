"""Queries over the driver tables, each with the DuckDB SQL that gives the same rows.

Roles: orders are games, customers and suppliers the players (account balances are ratings), lineitem the time controls,
events and conversations ordered plies, embeddings predictions. Move texts, buckets and dump names are derived from keys
by arithmetic that both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import parse, scores, tokens
from plyforge.operators import board, buckets, evaluation, sampling, sequences
from plyforge.plans import jobs
from plyforge.sources import games as sources
from plyforge.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- histograms and counts

RATING_EDGES = [float(e) for e in range(0, 10001, 1000)]
HIST_EDGES = [0.0, 1000.0, 2000.0, 4000.0, 6000.0, 8000.0, 9000.0]
TIME_EDGES = [0.0, 300.0, 600.0, 1800.0, 10800.0]


def bin_sql(x: str, edges: list[float]) -> str:
    parts = [f"when {x} >= {a} and {x} {'<=' if i == len(edges) - 2 else '<'} {b} then {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return f"case {' '.join(parts)} end"


PAIRS = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey"


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Games with both players: lineitems of a time control of 10 or more with their customer and supplier."""
    lines = table(spark, d, "lineitem").where("l_quantity >= 10").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    )


@query(
    f"""
    with p as (select {bin_sql('c_acctbal', RATING_EDGES)} as a, {bin_sql('s_acctbal', RATING_EDGES)} as b from {PAIRS} where l_quantity >= 10)
    select greatest(a, b) as i, least(a, b) as j, count(*) as n from p where a is not null and b is not null group by all
    """
)
def pair_matrix(spark, d):
    return buckets.pair_matrix(paired(spark, d), "c_acctbal", "s_acctbal", RATING_EDGES)


@query(
    f"""
    with bins as (select unnest([{', '.join(f"{{'bin': {i}, 'low': {a}::double, 'high': {b}::double}}" for i, (a, b) in enumerate(zip(HIST_EDGES, HIST_EDGES[1:])))}]) as r),
    c as (select {bin_sql('c_acctbal', HIST_EDGES)} as bin, count(*) as n from customer group by all)
    select r.bin as bin, r.low as low, r.high as high, coalesce(n, 0) as n from bins left join c on r.bin = c.bin
    """
)
def rating_hist(spark, d):
    return buckets.histogram(table(spark, d, "customer"), "c_acctbal", HIST_EDGES)


@query(
    f"""
    with t as (select case when l_linenumber = 1 then 'none' when l_linenumber > 1 then 'some' end as class, {bin_sql('l_quantity * 60', TIME_EDGES)} as bin from lineitem)
    select class, bin, count(*) as n from t where class is not null and bin is not null group by all
    """
)
def time_hist_by_class(spark, d):
    klass = F.when(F.col("l_linenumber") == 1, "none").when(F.col("l_linenumber") > 1, "some")
    return buckets.classed_histogram(table(spark, d, "lineitem").withColumn("seconds", F.col("l_quantity") * 60), "seconds", klass, TIME_EDGES)


@query(
    """
    with x as (select c_acctbal as v from customer union all select s_acctbal from supplier)
    select count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from x
    """
)
def whiten_params(spark, d):
    both = table(spark, d, "customer").select(F.col("c_acctbal").alias("v")).unionAll(table(spark, d, "supplier").select(F.col("s_acctbal").alias("v")))
    return buckets.whiten_params(both, "v").select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    """
    with c as (select conv_id, count(*) as n from conversations group by conv_id),
    s as (select coalesce(sum(n) over (order by conv_id rows between unbounded preceding and 1 preceding), 0) as start from c),
    l as (select lead(start) over (order by start) - start as d from s)
    select count(d) as n, max(d)::bigint as longest, round(avg(d), 6) as mean, round(stddev_pop(d), 6) as std from l where d is not null
    """
)
def seq_length_stats(spark, d):
    counts = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    out = sequences.lengths(sequences.prefix_starts(counts, "conv_id", "n"), "start")
    return out.select("n", "longest", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def priced(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


@query(
    """
    select c_mktsegment, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey
    where o_totalprice >= 250000 group by all having count(*) >= 290
    """
)
def bucket_counts(spark, d):
    return buckets.bucket_counts(priced(spark, d), ["c_mktsegment", "o_orderpriority"], F.col("o_totalprice") >= 250000, 290)


SKEWED = "select c_nationkey, o_orderkey from orders join customer on o_custkey = c_custkey where o_totalprice >= 19000 * c_nationkey"
QUOTAS = f"""
    rows_ as ({SKEWED}),
    counts as (select c_nationkey, count(*) as n from rows_ group by c_nationkey having count(*) >= 10),
    quotas as (select c_nationkey, n, least(max(n) over (), {{repeats}} * n) as quota from counts)"""


def skewed(spark, d):
    return priced(spark, d).where("o_totalprice >= 19000 * c_nationkey").select("c_nationkey", "o_orderkey")


def skewed_quotas(spark, d, repeats):
    return buckets.quotas(buckets.bucket_counts(skewed(spark, d), ["c_nationkey"], F.lit(True), 10), repeats)


@query(f"with {QUOTAS.format(repeats=10)} select * from quotas")
def bucket_quota(spark, d):
    return skewed_quotas(spark, d, 10)


OVERSAMPLED = f"""{QUOTAS.format(repeats=3)},
    ranked as (select *, row_number() over (partition by c_nationkey order by o_orderkey) - 1 as i from rows_),
    copies as (
      select c_nationkey, o_orderkey, i, n, unnest(range(0, (quota - 1 - i) // n + 1)) as copy from ranked join quotas using (c_nationkey) where i < quota
    ),
    turns as (select c_nationkey, o_orderkey, copy, copy * n + i as turn from copies)"""


@query(f"with {OVERSAMPLED} select * from turns")
def oversample_to_quota(spark, d):
    return sampling.oversampled(skewed(spark, d), skewed_quotas(spark, d, 3), "c_nationkey", ["o_orderkey"])


@query(f"with {OVERSAMPLED} select turn, string_agg(c_nationkey::varchar, ',' order by c_nationkey) as nations, count(*) as n from turns group by turn")
def round_robin_turns(spark, d):
    turns = oversample_to_quota(spark, d)
    return turns.groupBy("turn").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("c_nationkey")), lambda x: x.cast("string")), ",").alias("nations"), F.count("*").alias("n")
    )


# ---------------------------------------------------------------- splits, shards, merges


@query(
    """
    with r as (select o_orderkey, row_number() over (order by md5('42|' || o_orderkey)) - 1 as k, count(*) over () as n from orders)
    select o_orderkey, case when k < n * 5 // 100 then 'val' when k < n * 5 // 100 + n * 7 // 100 then 'test' else 'train' end as split from r
    """
)
def quota_split(spark, d):
    return sampling.quota_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 42, 5, 7)


@query(
    """
    with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as k,
                      greatest(1, count(*) over (partition by o_orderpriority) // 500) as size from orders),
    c as (select *, k // size as chunk from r),
    u as (select *, ('0x' || substr(md5('42|' || o_orderpriority || '|' || chunk), 1, 8))::bigint / 4294967296.0 as x from c)
    select o_orderkey, o_orderpriority, chunk, case when x < 0.1 then 'val' when x < 0.25 then 'test' else 'train' end as split from u
    """
)
def chunk_split(spark, d):
    return sampling.chunk_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 42, 0.1, 0.15)


@query(
    """
    with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as k,
                      count(*) over (partition by c_mktsegment) // 7 as size from customer)
    select c_custkey, c_mktsegment, k // size as shard from r where k < size * 7
    """
)
def rank_shard(spark, d):
    return sampling.rank_shard(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"], 7, ["c_mktsegment"])


TREE = """
    (select c_custkey,
            (c_custkey % 8 * 500)::varchar || case when c_custkey % 3 = 0 then '+' else '' end as a,
            case when c_custkey % 50 = 0 then 'other' else (c_nationkey * 200)::varchar || case when c_custkey % 5 = 0 then '+' else '' end end as b
     from customer)"""
NUMBER = "try_cast(regexp_extract({x}, '^(\\d{{1,9}})\\+?$', 1) as int)"
ROLLED = f"""
    t as (select *, {NUMBER.format(x='a')} as av, a like '%+' as ap, {NUMBER.format(x='b')} as bv, b like '%+' as bp from {TREE}),
    u as (select *, av <= 2000 and not ap as keeps, av > 2000 or (av = 2000 and ap) as above from t),
    v as (select *, case when keeps then a when above then '2000+' end as ta,
                 case when bv is null then null
                      when keeps then case when bv = 2000 and not bp then b when bv >= 2000 then '2000+' else b end
                      when above then case when bv <= 2000 and not bp then b when bv >= 2000 then '2000+' end end as tb from u)"""


def bucket_tree(spark, d):
    plus = lambda m: F.when(F.col("c_custkey") % m == 0, "+").otherwise("")
    outer = F.concat((F.col("c_custkey") % 8 * 500).cast("string"), plus(3))
    inner = F.when(F.col("c_custkey") % 50 == 0, "other").otherwise(F.concat((F.col("c_nationkey") * 200).cast("string"), plus(5)))
    return table(spark, d, "customer").select("c_custkey", outer.alias("a"), inner.alias("b"))


@query(f"with {ROLLED} select ta as a, tb as b, count(*) as n from v where ta is not null and tb is not null group by all")
def merge_threshold(spark, d):
    return buckets.merge_buckets(bucket_tree(spark, d), "a", "b", 2000).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    f"""with {ROLLED} select a as "outer", b as "inner", case when tb is not null then ta end as to_outer, case when ta is not null then tb end as to_inner, count(*) as n from v group by all"""
)
def merge_dry_run(spark, d):
    return buckets.merge_plan(bucket_tree(spark, d), "a", "b", 2000)


@query(
    f"""
    with n as (select distinct b as name from {TREE}), p as (select name, {NUMBER.format(x='name')} as value, name like '%+' as plus from n)
    select name, value, plus, row_number() over (order by value, plus, name) - 1 as place from p where value is not null
    """
)
def bucket_name_parse(spark, d):
    from pyspark.sql import Window

    tree = bucket_tree(spark, d).select(F.lit("0").alias("w_bucket"), F.col("b").alias("b_bucket"))
    names = sources.bucket_catalog(tree).select(F.col("b_bucket").alias("name"))
    parsed = names.select("name", parse.bucket_value(F.col("name")).alias("value"), parse.bucket_plus(F.col("name")).alias("plus")).where("value is not null")
    # A row a bucket name: the catalogue is small whatever the data's size.
    return parsed.withColumn("place", (F.row_number().over(Window.orderBy("value", "plus", "name")) - 1).cast("long"))


# ---------------------------------------------------------------- sequences and joins

PLIES = "(select *, row_number() over (partition by user_id order by ts, event_id) - 1 as ply from events)"


def event_plies(spark, d):
    return sequences.plies(table(spark, d, "events"), "user_id", ["ts", "event_id"])


@query(
    f"""
    with p as {PLIES}, w as (select *, lag(value, 1) over g as one, lag(value, 2) over g as two, lag(event_type) over g as best from p window g as (partition by user_id order by ply)),
    x as (select user_id, ply, best, case when ply % 2 = 0 then one - two else two - one end as gain, case when ply % 2 = 0 then one - value else value - one end as cp_loss from w)
    select user_id, ply, round(gain, 6) as gain, round(cp_loss, 6) as cp_loss, best from x where gain >= 50 and cp_loss >= 0.5 * gain
    """
)
def miss_mining(spark, d):
    out = sequences.misses(event_plies(spark, d), "user_id", "value", 50, 0.5, "event_type")
    return out.select("user_id", "ply", F.round("gain", 6).alias("gain"), F.round("cp_loss", 6).alias("cp_loss"), "best")


@query(
    f"""
    with p as {PLIES}, w as (select *, max(case when value > 300 then 1 else 0 end) over (partition by user_id order by ply rows between unbounded preceding and current row) as bad from p)
    select user_id, ply, event_id from w where bad = 0
    """
)
def stop_at_first_bad(spark, d):
    return sequences.until_first(event_plies(spark, d), "user_id", F.col("value") > 300).select("user_id", "ply", "event_id")


@query(
    """
    with n as (select c_nationkey, count(*) as n from customer group by c_nationkey),
    s as (select *, coalesce(sum(n) over (order by c_nationkey rows between unbounded preceding and 1 preceding), 0) as start from n),
    i as (select o_orderkey, o_orderkey * 7 % 2000 as idx from orders)
    select o_orderkey, idx, c_nationkey, (idx - start)::bigint as place from i join s on idx >= start and idx < start + n
    """
)
def prefix_locate(spark, d):
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    indices = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 2000).alias("idx"))
    return sequences.located(indices, "idx", counts, "c_nationkey", "n")


@query(
    """
    with s as (select distinct conv_id, 1 as gs, 2 + conv_id % 2 as nmoves from conversations)
    select conv_id, turn, role from conversations join s using (conv_id) where turn >= gs and turn < gs + nmoves
    """
)
def gather_slice(spark, d):
    values = table(spark, d, "conversations").select("conv_id", "turn", "role")
    slices = values.select("conv_id", F.lit(1).alias("gs"), (2 + F.col("conv_id") % 2).alias("nmoves")).distinct()
    return sequences.gathered(values, "conv_id", "turn", slices).select("conv_id", "turn", "role")


@query(
    """
    with idx as (select l_orderkey as gidx, l_suppkey as blk, count(*) as moves from lineitem where l_linenumber <= 3 group by all)
    select o_orderkey, blk, moves, o_orderstatus, s_acctbal from idx join orders on gidx = o_orderkey join supplier on blk = s_suppkey
    """
)
def index_gather(spark, d):
    idx = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("gidx"), F.col("l_suppkey").alias("blk")).agg(F.count("*").alias("moves"))
    games, players = table(spark, d, "orders"), table(spark, d, "supplier")
    found = sequences.looked_up(sequences.looked_up(idx, "gidx", games, "o_orderkey"), "blk", players, "s_suppkey")
    return found.select("o_orderkey", "blk", "moves", "o_orderstatus", "s_acctbal")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000 and o_custkey is not null)")
def anti_ledger(spark, d):
    done = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("file"))
    work = table(spark, d, "customer").select(F.col("c_custkey").alias("file"), "c_name")
    return ingest.remaining(work, done).select(F.col("file").alias("c_custkey"), "c_name")


@query(
    """
    select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity >= 49)
    and s_nationkey in (select n_nationkey from nation where n_regionkey = 1)
    """
)
def semi_ledger(spark, d):
    on_disk = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("file"))
    work = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), "s_name", "s_nationkey")
    listed = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    fetched = work.join(listed, "s_nationkey", "left_semi")
    return ingest.landed(work, on_disk, fetched).select(F.col("file").alias("s_suppkey"), "s_name")


POSITIONS = "(select conv_id, turn, md5(role || '|' || turn || '|' || length(text) // 40) as position from conversations)"


def positions(spark, d):
    key = F.md5(F.concat_ws("|", "role", F.col("turn").cast("string"), F.expr("length(text) div 40").cast("string")).cast("binary"))
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("position"))


@query(
    f"""
    with p as {POSITIONS}, train as (select distinct position from p where conv_id % 2 = 0)
    select conv_id, count(*) as n, string_agg(turn::varchar, ',' order by turn) as plies from p
    where conv_id % 2 = 1 and position not in (select position from train) group by conv_id
    """
)
def novel_positions(spark, d):
    p = positions(spark, d)
    novel = sequences.novel(p.where("conv_id % 2 = 1"), "position", p.where("conv_id % 2 = 0"))
    return novel.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("plies"))


@query(f"select count(distinct position) as n from {POSITIONS}")
def distinct_positions(spark, d):
    return sequences.distinct_count(positions(spark, d), "position")


@query(
    f"""
    with p as (select user_id, ply, round(value * 100)::bigint as cents from {PLIES})
    select user_id, ply, avg(cents) over g as running_mean, max(cents) over g as running_max from p
    window g as (partition by user_id order by ply rows between unbounded preceding and current row)
    """
)
def running_metrics(spark, d):
    cents = event_plies(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return sequences.running_metrics(cents, "user_id", ["ply"], "cents").select("user_id", "ply", "running_mean", "running_max")


@query(f"select user_id, ply, event_id from {PLIES} where ply < 20")
def first_k_positions(spark, d):
    return sequences.first_k(table(spark, d, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "ply", "event_id")


@query(
    f"""
    with p as {PLIES}, n as (select *, count(*) over (partition by user_id) as n from p),
    w as (select *, 1.0::double / (4 * (n + 1)) as least_, (1.0::double / (n + 1) - 1.0::double / (4 * (n + 1))) * (2.0::double / n) as rise,
                 ('0x' || substr(md5('7|' || user_id), 1, 8))::bigint / 4294967296.0::double as x from n),
    f as (select user_id, event_id, ply, row_number() over (partition by user_id order by ply) - 1 as k from w where x < (ply + 1) * least_ + rise * (ply * (ply + 1) / 2.0::double))
    select user_id, event_id, ply, k from f where k < 10
    """
)
def skew_sample(spark, d):
    out = sampling.skewed_prefix(event_plies(spark, d), "user_id", ["ply"], 10, 7)
    return out.select("user_id", "event_id", "ply", "k")


@query(
    """
    select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all
    """
)
def event_windows(spark, d):
    return ingest.windowed(table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type").withColumn("total", F.round("total", 4))


# ---------------------------------------------------------------- move texts

#: Moves that games are built of.
MOVES = ["e4", "Nf3", "exd5", "O-O", "N1d2", "Qxf7+", "e8=Q#", "O-O-O", "Rad1", "a9"]
LENGTH = 5
MOVES_SQL = "array_to_string([" + ", ".join(f"([{', '.join(repr(m) for m in MOVES)}])[(o_orderkey // {3**i} + {i}) % {len(MOVES)} + 1]" for i in range(LENGTH)) + "], ' ')"
CLOCKS_SQL = "array_to_string([" + ", ".join(f"((o_orderkey * {7 + i}) % 300 + {i})::varchar" for i in range(LENGTH)) + "], ' ')"
GAMES_SQL = f"(select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {MOVES_SQL} as moves, {CLOCKS_SQL} as clk from orders)"


def games(spark, d):
    key = F.col("o_orderkey")
    at = lambda i: F.element_at(F.array(*map(F.lit, MOVES)), ((F.floor(key / 3**i) + i) % len(MOVES) + 1).cast("int"))
    moves = F.concat_ws(" ", *(at(i) for i in range(LENGTH)))
    clocks = F.concat_ws(" ", *(((key * (7 + i)) % 300 + i).cast("string") for i in range(LENGTH)))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", moves.alias("moves"), clocks.alias("clk"))


def sql_list(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


VOCAB_SQL = "map {" + ", ".join(f"'{t}': {i}" for t, i in tokens.vocabulary().items()) + "}"
def pieces_sql(x: str, pattern: str = tokens.MOVE_PATTERN) -> str:
    return f"regexp_extract_all({x}, '{pattern}', 0)"


def groups_sql(x: str) -> str:
    return pieces_sql(x, tokens.MOVE_GROUP_PATTERN)


def ids_sql(x: str) -> str:
    known = f"({VOCAB_SQL})[p]"
    parts = f"case when {known} is not null then [{known}] else list_transform(string_split(p, ''), lambda c: ({VOCAB_SQL})[c]) end"
    return f"list_filter(flatten(list_transform({pieces_sql(x)}, lambda p: {parts})), lambda i: i is not null)"


def digits_sql(c: str) -> str:
    value = f"case when substr({c}, j, 1) = '0' then '0' else substr({c}, j, 1) || repeat('0', (length({c}) - j)::int) end"
    return f"list_transform(range(1, length(rtrim({c}, '0')) + 1), lambda j: {value})"


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"select o_orderkey, array_to_string({pieces_sql('moves')}, ',') as pieces, array_to_string({ids_sql('moves')}, ',') as ids from {GAMES_SQL}")
def regex_tokens(spark, d):
    return games(spark, d).select("o_orderkey", joined(tokens.move_pieces(F.col("moves"))).alias("pieces"), joined(tokens.move_ids(F.col("moves"))).alias("ids"))


@query(f"select o_orderkey, array_to_string(list_transform(string_split(moves, ' '), lambda w: array_to_string({groups_sql('w')}, ',')), '|') as groups from {GAMES_SQL}")
def move_groups(spark, d):
    return games(spark, d).select("o_orderkey", F.array_join(F.transform(tokens.move_groups(F.col("moves")), lambda g: F.array_join(g, ",")), "|").alias("groups"))


@query(f"select o_orderkey, array_to_string({digits_sql('(o_orderkey * 15)::varchar')}, ',') as digits from orders")
def clock_digits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tokens.clock_digits(F.col("o_orderkey") * 15), ",").alias("digits"))


@query(
    f"""
    with g as (select o_orderkey, string_split(clk, ' ') as c, string_split(moves, ' ') as m from {GAMES_SQL})
    select o_orderkey, array_to_string(flatten(list_transform(range(1, {LENGTH + 1}), lambda i: list_concat({digits_sql('c[i]')}, {groups_sql('m[i]')}))), ',') as game from g
    """
)
def interleave(spark, d):
    return games(spark, d).select("o_orderkey", F.array_join(tokens.interleaved(F.col("clk"), F.col("moves")), ",").alias("game"))


def upto_sql(x: str, edges, rest: str) -> str:
    return f"case {' '.join(f"when {x} <= {e} then '<|{n}|>'" for e, n in edges)} else {rest} end"


HEADER_SQL = f"""
    (select o_orderkey, moves, (c_acctbal / 3)::int as white, (abs(c_acctbal) / 3.2)::int as black, (o_orderkey * 37 % 4000)::int as seconds, (o_orderkey % 36)::int as inc, o_orderstatus
     from {GAMES_SQL} join customer on o_custkey = c_custkey)"""
RATING_SQL = "case when {x} > 2600 then '<|ELOMAX|>' else " + upto_sql("{x}", [(e, f"ELO{e}") for e in tokens.RATING_EDGES], "'<|ELOMAX|>'") + " end"
INC_SQL = "case when inc = 0 then '<|0SECONDS|>' when inc = 1 then '<|1SECOND|>' else " + upto_sql("inc", tokens.INCREMENT_EDGES, "case when inc = 30 then '<|30SECONDS|>' else '<|MAXSECONDS|>' end") + " end"


@query(
    f"""
    with t as (select o_orderkey, {RATING_SQL.format(x='white')} as w, {RATING_SQL.format(x='black')} as b, {upto_sql('seconds', tokens.TIME_EDGES, "'<|3HOURS|>'")} as tc, {INC_SQL} as inc,
                      case o_orderstatus when 'F' then 1 when 'O' then -1 when 'P' then 0 end as outcome, moves from {HEADER_SQL})
    select o_orderkey, w, b, tc, inc, outcome, w || ' ' || b || ' ' || tc || ' ' || inc || ' ' || moves as game from t
    """
)
def header_tokens(spark, d):
    players = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    g = games(spark, d).join(players, F.col("o_custkey") == F.col("c_custkey"))
    whole = lambda x: F.rint(x).cast("int")
    g = g.withColumn("white", whole(F.col("c_acctbal") / 3)).withColumn("black", whole(F.abs("c_acctbal") / 3.2))
    result = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2)
    told = g.select(
        "o_orderkey", tokens.rating_token(F.col("white"), 2600).alias("w"), tokens.rating_token(F.col("black"), 2600).alias("b"),
        tokens.time_token((F.col("o_orderkey") * 37 % 4000).cast("int")).alias("tc"), tokens.increment_token((F.col("o_orderkey") % 36).cast("int")).alias("inc"),
        tokens.outcome(result).alias("outcome"), "moves",
    )
    return told.select("o_orderkey", "w", "b", "tc", "inc", "outcome", tokens.game_text(F.col("w"), F.col("b"), F.col("tc"), F.col("inc"), F.col("moves")).alias("game"))


@query(
    f"""
    with v as (select unnest({sql_list(tokens.vocabulary())}) as token), u as (select unnest({pieces_sql('moves')}) as token from {GAMES_SQL}),
    c as (select token, count(*) as n from u group by token)
    select v.token as token, coalesce(n, 0) as n from v left join c on v.token = c.token
    """
)
def token_freq(spark, d):
    vocabulary = spark.createDataFrame([(t,) for t in tokens.vocabulary()], "token string")
    used = games(spark, d).select(F.explode(tokens.move_pieces(F.col("moves"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return F.broadcast(vocabulary).join(used, "token", "left").select("token", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


FREQ_EDGES = [0.0, 0.1, *(10.0**e for e in range(2, 11))]


@query(f"with f as ({ORACLE_SQL['token_freq']}) select {bin_sql('n', FREQ_EDGES)} as bin, count(*) as n, round(sum(log10(case when n > 0 then n end)), 6) as logs from f where {bin_sql('n', FREQ_EDGES)} is not null group by 1")
def freq_hist(spark, d):
    counts = token_freq(spark, d).select(buckets.bin_index(F.col("n"), FREQ_EDGES).alias("bin"), scores.log10_or_null(F.col("n")).alias("log"))
    return counts.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("log"), 6).alias("logs"))


@query(
    f"""
    with g as (select o_orderkey, o_orderpriority, ({ids_sql('moves')})[1:12] as ids, (row_number() over (partition by o_orderpriority order by o_orderkey) - 1) // 64 as batch from {GAMES_SQL}),
    w as (select *, max(len(ids)) over (partition by o_orderpriority, batch) as width from g)
    select o_orderkey, o_orderpriority, batch, width, array_to_string(list_resize(ids, width, 103), ',') as ids from w
    """
)
def pad_batch(spark, d):
    ids = F.slice(tokens.move_ids(F.col("moves")), 1, 12)
    out = sampling.padded(games(spark, d).select("o_orderkey", "o_orderpriority", ids.alias("ids")), "ids", ["o_orderkey"], 64, ["o_orderpriority"], tokens.NOOP)
    return out.select("o_orderkey", "o_orderpriority", "batch", "width", joined(F.col("ids")).alias("ids"))


@query(f"select {max(tokens.special_tokens().values()) + 1} as size, {len(tokens.vocabulary())} as plain, {len(tokens.special_tokens())} as special")
def vocab_size(spark, d):
    both = spark.createDataFrame([(tokens.vocabulary(), tokens.special_tokens())], "plain map<string,int>, special map<string,int>")
    return both.select((F.array_max(F.map_values(F.map_concat("plain", "special"))) + 1).alias("size"), F.size("plain").alias("plain"), F.size("special").alias("special"))


#: Positions in FEN whose counters and board field the queries take.
FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "8/8/8/8/8/8/8/K1k5 w - - 0 1",
    "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq e6 0 2",
]


@query(f"with f as (select unnest({sql_list(FENS)}) as fen) select fen, array_to_string((string_split(fen, ' '))[1:-3], ' ') as trimmed, replace(string_split(fen, ' ')[1], '/', '') as board from f")
def fen_trim(spark, d):
    fens = spark.createDataFrame([(f,) for f in FENS], "fen string")
    return fens.select("fen", tokens.fen_trimmed(F.col("fen")).alias("trimmed"), tokens.fen_board(F.col("fen")).alias("board"))


# ---------------------------------------------------------------- predictions

RANKED = """
    (select vec_id, label, pos, p, row_number() over (partition by vec_id order by p desc, pos) as rank from
      (select vec_id, label, unnest(range(0, 64)) as pos, unnest(embedding)::double as p from embeddings))"""


def predictions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "p")).withColumn("p", F.col("p").cast("double"))


@query(
    f"""
    with b as (select vec_id, min(case when pos % 10 = label then rank end) as best from {RANKED} where rank <= 5 group by vec_id), t as (select unnest([1, 3, 5]) as top)
    select top::bigint as top, count(*) filter (where best <= top) as hits, count(*) as total, round(count(*) filter (where best <= top) / count(*), 9) as accuracy from b, t group by top
    """
)
def topn_accuracy(spark, d):
    found = evaluation.ranked(predictions(spark, d), ["vec_id"], "pos", "p", 5)
    return evaluation.top_n_accuracy(found, ["vec_id"], F.col("pos") % 10 == F.col("label"), [1, 3, 5]).withColumn("accuracy", F.round("accuracy", 9))


@query(
    f"""
    select ply // 10 as band, count(*) filter (where value > 100 and event_type <> 'view') as hits, count(*) filter (where event_type <> 'view') as total,
           round(count(*) filter (where value > 100 and event_type <> 'view') / nullif(count(*) filter (where event_type <> 'view'), 0), 9) as accuracy
    from {PLIES} group by 1
    """
)
def band_accuracy(spark, d):
    out = evaluation.band_accuracy(event_plies(spark, d), "ply", F.col("value") > 100, F.col("event_type") != "view")
    return out.withColumn("accuracy", F.round("accuracy", 9))


SIDES = f"""
    (select {bin_sql('c_acctbal', RATING_EDGES)} as w, {bin_sql('s_acctbal', RATING_EDGES)} as b, l_linenumber % 2 as side, count(*) as moves,
            count(*) filter (where l_quantity >= 30) as correct, round(sum(abs(l_quantity - 25)), 4) as abs_error
     from {PAIRS} where l_quantity >= 10 and c_acctbal >= 0 and s_acctbal >= 0 group by all)"""


@query(f"select w, b, side::bigint as side, moves, correct, abs_error from {SIDES}")
def side_matrix(spark, d):
    p = paired(spark, d).withColumn("w", buckets.bin_index(F.col("c_acctbal"), RATING_EDGES)).withColumn("b", buckets.bin_index(F.col("s_acctbal"), RATING_EDGES))
    out = evaluation.side_matrix(p, "w", "b", "l_linenumber", F.col("l_quantity") >= 30, F.col("l_quantity") - 25, (F.col("c_acctbal") >= 0) & (F.col("s_acctbal") >= 0))
    return out.withColumn("abs_error", F.round("abs_error", 4))


@query(f"select w, b, case when sum(moves) = 0 then '-' else printf('%.1f', 100.0::double * sum(correct) / sum(moves)) end as accuracy from {SIDES} group by w, b")
def matrix_report(spark, d):
    return evaluation.matrix_report(side_matrix(spark, d))


@query(
    f"""
    with p as (select *, lead(value) over (partition by user_id order by ply) as next from {PLIES})
    select count(*) as n, round(avg(value), 6) as mean_target, round(avg(next), 6) as mean_adjacent from p where event_type <> 'view'
    """
)
def target_prob_mean(spark, d):
    from pyspark.sql import Window

    p = event_plies(spark, d).withColumn("next", F.lead("value").over(Window.partitionBy("user_id").orderBy("ply")))
    out = evaluation.target_probability(p, "value", "next", F.col("event_type") != "view")
    return out.select("n", F.round("mean_target", 6).alias("mean_target"), F.round("mean_adjacent", 6).alias("mean_adjacent"))


@query(
    f"""
    with p as (select *, lag(value) over (partition by user_id order by ply) as before from {PLIES}), q as (select ply % 5 as head, value as cp, before as tp from p where before > 0)
    select head, round(avg(case when cp < tp then cp / tp end), 6) as below, count(*) filter (where cp < tp) as n_below, round(avg(case when cp >= tp then cp / tp end), 6) as above,
           count(*) filter (where cp >= tp) as n_above from q group by head
    """
)
def ratio_means(spark, d):
    from pyspark.sql import Window

    p = event_plies(spark, d).withColumn("before", F.lag("value").over(Window.partitionBy("user_id").orderBy("ply"))).where("before > 0")
    out = evaluation.ratio_means(p.withColumn("head", F.col("ply") % 5), "head", "value", "before")
    return out.withColumn("below", F.round("below", 6)).withColumn("above", F.round("above", 6))


@query("select event_id, case when value < 100 then -1 else (event_id % 94)::int end as token from events")
def mask_tokens(spark, d):
    return evaluation.masked_tokens(table(spark, d, "events").withColumn("token", (F.col("event_id") % 94).cast("int")), "token", "value", 100.0).select("event_id", "token")


@query(
    """
    with b as (select user_id, avg(case when event_type = 'click' and value > 60 then value end) as a, avg(case when event_type = 'view' and value > 60 then value end) as b from events group by user_id)
    select round(avg(coalesce(a, 0)), 6) as a, round(avg(coalesce(b, 0)), 6) as b from b
    """
)
def mean_with_default(spark, d):
    of = lambda kind: F.avg(F.when((F.col("event_type") == kind) & (F.col("value") > 60), F.col("value")))
    per = table(spark, d, "events").groupBy("user_id").agg(of("click").alias("a"), of("view").alias("b"))
    out = evaluation.mean_with_default(per, "a", "b")
    return out.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


LEGAL = "(select user_id, value <= 200 as legal, event_type as reason from events)"


def _legality(spark, d):
    return evaluation.legality(table(spark, d, "events"), "user_id", F.col("value") <= 200, "event_type")


@query(
    f"""
    with g as (select user_id, count(*) filter (where not legal) as fails, count(*) as moves from {LEGAL} group by user_id)
    select count(*) as games, count(*) filter (where fails = 0) as legal_games, sum(moves)::bigint as moves, sum(moves - fails)::bigint as legal_moves from g
    """
)
def legal_frequency(spark, d):
    return _legality(spark, d)[0]


@query(
    f"""
    with g as (select user_id, count(*) filter (where not legal) as fails from {LEGAL} group by user_id), e as (select unnest(range(1, fails + 1)) as nth from g)
    select nth, count(*) as games from e group by nth
    """
)
def nth_failures(spark, d):
    return _legality(spark, d)[1]


@query(f"select reason as event_type, count(*) as n from {LEGAL} where not legal group by reason")
def failure_reasons(spark, d):
    return _legality(spark, d)[2]


# ---------------------------------------------------------------- scores, budgets, names


@query(
    """
    with s as (select event_id, (value * 8 - 1500)::int as rel, case when event_id % 17 = 0 then (event_id % 5 - 2)::int end as mate, event_id % 2 = 0 as white from events)
    select event_id, case when mate is not null then 1000 * case when mate = 0 then case when white then -1 else 1 end when mate > 0 then case when white then 1 else -1 end else case when white then -1 else 1 end end
                          else greatest(least(case when white then rel else -rel end, 1000), -1000) end as score from s
    """
)
def score_clamp(spark, d):
    e = table(spark, d, "events")
    mate = F.when(F.col("event_id") % 17 == 0, (F.col("event_id") % 5 - 2).cast("int"))
    return e.select("event_id", scores.white_score(F.rint(F.col("value") * 8 - 1500).cast("int"), mate, F.col("event_id") % 2 == 0).alias("score"))


@query(
    """
    select 'tau' as missing, round(6.0::double * 1000 * 1e6 * 20 * 1e9 / (10 * 86400) / 1e12, 6) as value
    union all select 'days', round(6.0::double * 1000 * 1e6 * 20 * 1e9 / (100 * 1e12) / 86400, 6)
    union all select 'params', round(100.0::double * 1e12 * 10 * 86400 / 6 / (20 * 1e9), 6)
    union all select 'tokens', round(100.0::double * 1e12 * 10 * 86400 / 6 / (1000 * 1e6), 6)
    """
)
def compute_budget(spark, d):
    known = {"tau": 100.0, "days": 10.0, "params": 1000.0, "tokens": 20.0}
    rows = [(m, scores.compute_budget(**{k: v for k, v in known.items() if k != m})) for m in known]
    return spark.createDataFrame(rows, "missing string, value double").withColumn("value", F.round("value", 6))


@query("select event_id, round(6.0::double * (event_id % 1000 + 1) * 8 * 764 / 1e12, 12) as teraflops from events")
def step_flops(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.round(scores.step_teraflops(F.col("event_id") % 1000 + 1, F.lit(8), F.lit(764)), 12).alias("teraflops")
    )


@query(
    """
    with s as (select unnest(range(0, 10001, 50))::bigint as step)
    select step, round(case when step < 1000 then 0.001::double * (1.0::double / 1000 + (1 - 1.0::double / 1000) * step / 1000)
                       else 0.00001::double + (0.001::double - 0.00001) * (1 + cos(pi() * (step - 1000) / 9000)) / 2 end, 9) as rate from s
    """
)
def lr_schedule(spark, d):
    steps = spark.range(0, 10001, 50).withColumnRenamed("id", "step")
    return steps.select("step", F.round(scores.learning_rate(F.col("step"), 0.001, 0.00001, 1000, 10000), 9).alias("rate"))


@query(
    """
    select event_id, (s // 3600)::varchar || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as elapsed, round(value * 1e6 / 1048576.0 / nullif(s, 0), 6) as speed
    from (select event_id, value, event_id * 13 % 90000 as s from events)
    """
)
def elapsed_speed(spark, d):
    s = (F.col("event_id") * 13 % 90000)
    return table(spark, d, "events").select(
        "event_id", scores.elapsed(s).alias("elapsed"), F.round(scores.megabytes_per_second(F.col("value") * 1e6, s), 6).alias("speed")
    )


DUMPS = "(select page_id, 'https://dumps.example.org/standard/db_standard_rated_' || (2017 + page_id % 9)::varchar || '-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || case when page_id % 11 = 0 then '.pgn' else '.pgn.zst' end as url from pages)"


def dump_urls(spark, d):
    year, month = (2017 + F.col("page_id") % 9).cast("string"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0")
    tail = F.when(F.col("page_id") % 11 == 0, ".pgn").otherwise(".pgn.zst")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("https://dumps.example.org/standard/db_standard_rated_"), year, F.lit("-"), month, tail).alias("url"))


@query(
    f"""
    select page_id, nullif(regexp_extract(url, '([^/]*pgn\\.zst)', 1), '') as file, nullif(regexp_extract(url, 'standard_rated_([0-9-]+)\\.pgn\\.zst', 1), '') as name from {DUMPS}
    """
)
def url_parse(spark, d):
    return dump_urls(spark, d).select("page_id", parse.dump_file(F.col("url")).alias("file"), parse.dump_name(F.col("url")).alias("name"))


NAMES = f"(select distinct regexp_extract(url, 'standard_rated_([0-9-]+)\\.pgn\\.zst', 1) as name from {DUMPS} where url like '%.zst')"


@query(f"select name, row_number() over (order by name desc) - 1 as turn from {NAMES} where name not like '2018%'")
def newest_first_worklist(spark, d):
    from pyspark.sql import Window

    names = dump_urls(spark, d).select(parse.dump_name(F.col("url")).alias("file")).where("file is not null").distinct()
    left = ingest.remaining(names, names.where("file like '2018%'")).withColumnRenamed("file", "name")
    # A row a monthly dump: the work list is small whatever the data's size.
    return left.withColumn("turn", (F.row_number().over(Window.orderBy(F.desc("name"))) - 1).cast("long"))


@query("select count(distinct o_custkey) as files, count(*) as games, round(count(distinct o_custkey) / (select count(*) from customer), 9) as share from orders")
def ledger_totals(spark, d):
    ledger = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.lit(1).alias("ngames"))
    return ingest.totals(ledger, table(spark, d, "customer")).withColumn("share", F.round("share", 9))


# ---------------------------------------------------------------- replayed games (no SQL: moves are played on a board)

#: Well-known openings, which games begin with.
OPENINGS = [
    "e4 e5 Nf3 Nc6 Bb5 a6 Ba4 Nf6 O-O Be7 Re1 b5 Bb3 d6 c3 O-O",
    "e4 e5 Nf3 Nc6 Bc4 Bc5 c3 Nf6 d4 exd4 cxd4 Bb4+ Nc3 Nxe4",
    "e4 c5 Nf3 d6 d4 cxd4 Nxd4 Nf6 Nc3 a6 Bg5 e6 f4 Be7 Qf3 Qc7 O-O-O",
    "e4 e6 d4 d5 Nc3 Nf6 Bg5 Be7 e5 Nfd7 Bxe7 Qxe7 f4 O-O",
    "e4 c6 d4 d5 exd5 cxd5 c4 Nf6 Nc3 e6 Nf3 Be7 cxd5 Nxd5",
    "d4 d5 c4 e6 Nc3 Nf6 Bg5 Be7 e3 O-O Nf3 Nbd7 Rc1 c6",
    "d4 Nf6 c4 g6 Nc3 Bg7 e4 d6 Nf3 O-O Be2 e5 O-O Nc6 d5 Ne7",
    "d4 Nf6 c4 e6 Nc3 Bb4 e3 O-O Bd3 d5 Nf3 c5 O-O Nc6",
    "c4 e5 Nc3 Nf6 Nf3 Nc6 g3 d5 cxd5 Nxd5 Bg2 Nb6 O-O Be7",
    "e4 d5 exd5 Qxd5 Nc3 Qa5 d4 Nf6 Nf3 Bf5 Bc4 e6 Bd2 c6",
    "e4 a6 e5 d5 exd6 cxd6 d4 Nf6 c4 g6",
    "e4 d5 exd5 c6 dxc6 Nf6 cxb7 Nbd7 bxa8=Q Nb6 Qxa7 Bd7",
]
#: Moves that a game ends with; where the position has no such move, its replay ends there.
LAST = ["h3 h6", "a3 a5", "Kh1 Kh8", "Nd5", "Qe2 Qe7", "b4", "O-O O-O", "Rb1 Rb8"]
VERY_LAST = ["a4 h5", "g3 g6", "Ne5", "h4 a6", "Kf1 Kf8", "d5", "Ra2", "Bf4 Bf5", "Qc2 Qc7", "g4 g5", "Re1 Re8"]


def openings(spark, d):
    """(o_orderkey, moves): a game an order, from 4 plies of an opening to all of it, and last moves."""
    key = F.col("o_orderkey")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    begun = F.slice(F.split(at(OPENINGS, key), " "), F.lit(1), (4 + F.floor(key / len(OPENINGS)) % 14).cast("int"))
    moves = F.concat_ws(" ", begun, at(LAST, F.floor(key / 7)), at(VERY_LAST, key))
    return table(spark, d, "orders").select("o_orderkey", moves.alias("moves"))


@query()
def replay_plies(spark, d):
    return board.replayed(openings(spark, d), "o_orderkey", "moves", 20)


@query()
def skew_board_positions(spark, d):
    return jobs.sampled_positions(openings(spark, d), "o_orderkey", 4, 7)


@query()
def novel_board_positions(spark, d):
    g = openings(spark, d)
    train, test = (g.where(f"o_orderkey % 10 {c}") for c in ("<> 1", "= 1"))
    return board.novel_plies(g, train, test, "o_orderkey", after=True).select("o_orderkey", "n", joined(F.col("plies")).alias("plies"))
