"""Many strategy specifications evaluated at once, with overfitting-aware statistics.

A specification is a set of atoms (bits), a hold length and a time window.  A
trade carries its own atom bits; trades are added up per own bits, and the few
sums are then added up for every set of bits in use.  Specifications only look
their cell up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from insidertrail.functions.distributions import normal_cdf, normal_quantile
from insidertrail.functions.scalars import ATOMS
from insidertrail.operators import ledger as L
from insidertrail.operators.single import single_row
from insidertrail.operators.staged import written
from insidertrail.params import RESEARCH, ResearchParams

SPEC_SCHEMA = "id string, base string, atoms array<string>, hold_days int, window string"
LEVER_SCHEMA = SPEC_SCHEMA + ", exits array<string>, sizing struct<type: string, k: double>"
WINDOW_SCHEMA = "window string, start_date date, end_date date"
DEFAULT_BASE = "cluster_buy"
EULER_GAMMA = 0.5772156649015329
CELL = ["required", "hold_days", "window"]
LEVERS = ["exit_bits", "size_index"]
FLAT = (None, 0.0)  # the sizing of a spec that names none


def seeded_rank(seed: Column, by: Sequence[str]) -> Column:
    """Position within the day in an order drawn from the seed."""
    draw = F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col("txn_id").cast("string")))
    return F.row_number().over(W.partitionBy(*by).orderBy(draw, "txn_id"))


# --- specifications ---------------------------------------------------------


def _bits(names: Column, atoms: Sequence[str]) -> Column:
    known = F.create_map(*[x for i, a in enumerate(atoms) for x in (F.lit(a), F.lit(1 << i))])
    return F.aggregate(F.transform(F.array_distinct(names), lambda a: F.try_element_at(known, a)),
                       F.lit(0), lambda acc, b: acc.bitwiseOR(b))


def core_key(base: Column, sizing: Column, exits: Column) -> Column:
    """What a spec is at its core, as text: base signal, kind and strength of sizing, exits in order; atoms do not count."""
    k = F.round(F.coalesce(sizing["k"], F.lit(0.0)), 4).cast("string")
    return F.concat_ws("|", base, F.coalesce(sizing["type"], F.lit("")), k, F.array_join(F.array_sort(exits), ","))


def resolve_specs(specs: DataFrame, windows: DataFrame, *, atoms: Mapping = ATOMS,
                  bases: Sequence[str] = (DEFAULT_BASE,), exits: Sequence[str] = (), sizes: Sequence[tuple] = (FLAT,),
                  banned: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): accepted specs carry required bits, complexity, ``exit_bits``, ``size_index`` and core key.

    Atoms replace the base signal: a spec with atoms is gated by them alone, one
    without is gated by its base signal (the bit after the atoms).  ``exits`` names the exit rules in use, ``sizes`` the
    (type, k) sizings; specs may lack both columns.  ``banned`` maps reasons to conditions on a spec; a banned one is
    rejected before anything else is looked at.
    """
    names = list(atoms)
    levers = {"exits": "array<string>", "sizing": "struct<type: string, k: double>"}
    given = specs.withColumns({c: F.lit(None).cast(kind) for c, kind in levers.items() if c not in specs.columns})
    filled = given.withColumns({
        "base": F.coalesce("base", F.lit(DEFAULT_BASE)), "hold_days": F.coalesce("hold_days", F.lit(60)),
        "atoms": F.coalesce("atoms", F.array().cast("array<string>")),
        "exits": F.coalesce("exits", F.array().cast("array<string>")),
        "sizing": F.struct(F.col("sizing.type").alias("type"), F.round(F.coalesce("sizing.k", F.lit(0.0)), 4).alias("k"))})
    same = [F.col("sizing.type").eqNullSafe(F.lit(name)) & (F.col("sizing.k") == round(k, 4)) for name, k in sizes]
    filled = filled.withColumn("size_index", F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(same)]))
    known = windows.select("window").distinct().withColumn("_w", F.lit(True))

    def unknown(column: str, allowed: Sequence[str]) -> Column:
        return F.size(F.array_except(column, F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))) > 0

    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for why, condition in (banned or {}).items():
        reason = reason.when(condition, F.lit(f"banned spec: {why}"))
    reason = (reason.when(~F.col("base").isin(list(bases)), F.concat(F.lit("unknown base signal "), "base"))
              .when(unknown("atoms", names), F.lit("unknown atom")).when(unknown("exits", exits), F.lit("unknown exit"))
              .when(F.col("size_index").isNull(), F.lit("unknown sizing"))
              .when(F.col("_w").isNull() & F.col("window").isNotNull(), F.concat(F.lit("unknown window "), "window")))
    checked = filled.join(known, "window", "left").withColumn("reason", reason).drop("_w")
    required = F.when(F.size("atoms") == 0, F.lit(1 << len(names))).otherwise(_bits(F.col("atoms"), names))
    accepted = checked.where(F.col("reason").isNull()).drop("reason").withColumns({
        "required": required, "complexity": F.size("atoms") + (F.col("base") != DEFAULT_BASE).cast("int"),
        "core_key": core_key(F.col("base"), F.col("sizing"), F.col("exits")),
        "exit_bits": _bits(F.col("exits"), exits) if exits else F.lit(0)}).drop("exits", "sizing")
    return accepted, checked.where(F.col("reason").isNotNull()).select("id", "reason")


def refuse_locked_window(specs: DataFrame, *, allow_test: bool = False) -> DataFrame:
    """Fails when a spec asks for the locked test window without permission."""
    if not allow_test and specs.where("window = 'test'").limit(1).count() > 0:
        raise PermissionError("a spec requests the test window, which is locked")
    return specs


# --- evaluation -------------------------------------------------------------


def own_bits(base_signal: Column, atoms: Mapping = ATOMS) -> Column:
    """A trade's atoms as bits, the base signal as the bit after them."""
    own = F.when(F.coalesce(base_signal, F.lit(False)), F.lit(1 << len(atoms))).otherwise(F.lit(0))
    for i, build in enumerate(atoms.values()):
        own = own.bitwiseOR(F.when(build(), F.lit(1 << i)).otherwise(F.lit(0)))
    return own


def spec_trades(flagged: DataFrame, prices: DataFrame, hold_days: Sequence[int], base_signal: Column, *,
                atoms: Mapping = ATOMS) -> DataFrame:
    """Ledger rows for each hold length with the trade's own atom bits."""
    rows = flagged.withColumn("own", own_bits(base_signal, atoms)).withColumn("known_on", F.coalesce("filing_date", "transaction_date"))
    from insidertrail.operators import asof

    led = asof.with_leads(prices.select("ticker", "date", "adj_close"), list(hold_days))
    w = W.partitionBy("ticker").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    series = led.withColumn("final", F.last(F.struct("date", "adj_close")).over(w))
    found = asof.bracket(rows.select("ticker", F.col("known_on").alias("as_of")), series, prev=False,
                         values=["adj_close", "final", *[f"fwd{h}" for h in hold_days]])
    out = asof.attach(rows, found, on="known_on").where(F.col("next.adj_close") > 0)
    legs = F.array(*[F.struct(F.lit(h).alias("hold_days"), F.coalesce(
        F.col(f"next.fwd{h}"), F.col("next.final")).alias("x")) for h in hold_days])
    out = out.select("txn_id", "insider_id", "ticker", "known_on", "own", F.col("next.date").alias("entry_date"),
                     F.col("next.adj_close").alias("entry_price"), F.explode(legs).alias("leg"))
    return L.with_pnl(out.select(
        "txn_id", "insider_id", "ticker", "known_on", "own", "entry_date", "entry_price", "leg.hold_days",
        F.col("leg.x.date").alias("exit_date"), F.col("leg.x.adj_close").alias("exit_price"),
        F.lit(500.0).alias("cost_basis")))


CARRIED = ("txn_id", "exit_date", "pnl", "pnl_pct")


def counted_trades(trades: DataFrame, required: Sequence[int], windows: Sequence[tuple], *,
                   by: Sequence[str] = ("hold_days",), carried: Sequence[str] = CARRIED) -> DataFrame:
    """Trades as they count: ``bits`` with ``exact`` false serves every set within them, with ``exact`` true that set alone.

    A trade repeating (insider, ticker, entry date) counts only where no earlier one of the window satisfied
    the same bits, so of the trades of one entry that have the same bits only the first matters.  Most
    entries then have one; only where bits differ is the first trade looked up set by set.  ``required``
    holds the distinct bit sets in use, ``by`` further keys of a trade, ``carried`` the columns kept.
    """
    entry = ["insider_id", "ticker", "entry_date", *by, "window"]
    known = F.col("known_on")
    spans = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).cast("date").alias("a"),
                               F.lit(b).cast("date").alias("b")) for n, a, b in windows])
    inside = F.filter(spans, lambda s: (s["a"].isNull() | (known >= s["a"])) & (s["b"].isNull() | (known <= s["b"])))
    values = F.struct(*carried)
    order = F.struct("known_on", "txn_id")
    rows = trades.withColumn("window", F.explode(F.transform(inside, lambda s: s["window"])))
    firsts = rows.groupBy(*entry, "own").agg(F.min(order).alias("order"), F.min_by(values, order).alias("v"))
    entries = firsts.groupBy(*entry).agg(F.count(F.lit(1)).alias("n"), F.first("own").alias("bits"), F.first("v").alias("v"))
    alone = entries.where("n = 1").select("bits", F.lit(False).alias("exact"), *by, "window", "v.*")
    differing = (firsts.join(entries.where("n > 1").select(*entry), entry, "left_semi")
                 .withColumn("bits", F.explode(_sets_within(F.col("own"), required)))
                 .groupBy(*entry, "bits").agg(F.min_by("v", "order").alias("v"))
                 .select("bits", F.lit(True).alias("exact"), *by, "window", "v.*"))
    return alone.unionByName(differing)


def _sets_within(bits: Column, required: Sequence[int]) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in required]), lambda m: bits.bitwiseAND(m) == m)


def cell_metrics(counted: DataFrame, required: Sequence[int], *, capital: float = 10_000.0,
                 levers: Sequence[str] = ()) -> DataFrame:
    """Trade statistics, return, drawdown and concentration per (required bits, hold, window) and ``levers``.

    Sums are made per own bits; only these few rows are added up for each set.  Every trade is kept, so the order
    of trades cannot matter and ``cv``, the spread over orders, is 0; ``levers.with_spread`` replaces it.
    """
    cell, own = [*CELL, *levers], ["bits", "exact", "hold_days", "window", *levers]

    def per_set(sums: DataFrame) -> DataFrame:
        sets = F.when(F.col("exact"), F.array("bits")).otherwise(_sets_within(F.col("bits"), required))
        return sums.withColumn("required", F.explode(sets)).drop("bits", "exact")

    pct = F.col("pnl_pct")
    powers = [F.sum(F.pow(pct, F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)]
    sums = (per_set(counted.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), *powers, F.sum("pnl").alias("pnl")))
            .groupBy(*cell).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3", "s4", "pnl")]))
    n, (m1, r2, r3, r4) = F.col("n"), [F.col(f"s{k}") / F.col("n") for k in (1, 2, 3, 4)]
    m2 = r2 - m1 * m1
    m2 = F.when(m2 > 1e-14 * r2, m2)  # equal returns have no spread
    base = sums.select(
        *cell, n.cast("double").alias("trades"), (F.col("pnl") / capital).alias("ret"),
        F.when(n > 1, F.coalesce(m1 / F.sqrt(m2 * n / (n - 1)), F.lit(0.0))).otherwise(0.0).alias("sr_hat"),
        ((r3 - 3 * m1 * r2 + 2 * m1 * m1 * m1) / F.pow(m2, F.lit(1.5))).alias("skew"),
        ((r4 - 4 * m1 * r3 + 6 * m1 * m1 * r2 - 3 * F.pow(m1, F.lit(4.0))) / (m2 * m2)).alias("kurtosis"))
    daily = (per_set(counted.groupBy(*own, "exit_date").agg(F.sum("pnl").alias("day_pnl")))
             .groupBy(*cell, "exit_date").agg(F.sum("day_pnl").alias("day_pnl")))
    w = W.partitionBy(*cell).orderBy("exit_date").rowsBetween(W.unboundedPreceding, 0)
    equity = daily.withColumn("equity", capital + F.sum("day_pnl").over(w))
    peak = F.greatest(F.lit(capital), F.max("equity").over(w))
    dd = (equity.withColumn("dd", (F.col("equity") - peak) / peak).groupBy(*cell)
          .agg(F.least(F.min("dd"), F.lit(0.0)).alias("maxdd")))
    gains = counted.where("pnl > 0")
    best = W.partitionBy(*own).orderBy(F.col("pnl").desc(), "txn_id")
    leading = per_set(gains.withColumn("r", F.row_number().over(best)).where("r <= 20").drop("r"))
    whole = (per_set(gains.groupBy(*own).agg(F.sum("pnl").alias("gain"))).groupBy(*cell).agg(F.sum("gain").alias("gain")))
    again = W.partitionBy(*cell).orderBy(F.col("pnl").desc(), "txn_id")
    top = (leading.withColumn("r", F.row_number().over(again)).where("r <= 20").groupBy(*cell)
           .agg(F.sum("pnl").alias("best")).join(whole, cell).select(*cell, (F.col("best") / F.col("gain")).alias("top20")))
    return (base.join(dd, cell).join(top, cell, "left")
            .withColumn("sharpe", F.col("sr_hat") * F.sqrt(252 / F.col("hold_days")))
            .withColumn("n_obs", F.col("trades")).withColumn("cv", F.lit(0.0)))


def evaluate(specs: DataFrame, metrics: DataFrame, levers: Sequence[str] = ()) -> DataFrame:
    return specs.join(metrics, [*CELL, *levers])


# --- overfitting statistics -------------------------------------------------


def expected_max_sharpe(n_trials: Column, sr_variance: Column) -> Column:
    """The largest Sharpe that ``n_trials`` without skill would be expected to reach; 0 for fewer than two."""
    n = n_trials.cast("double")
    best = (1 - EULER_GAMMA) * normal_quantile(1 - 1 / n) + EULER_GAMMA * normal_quantile(1 - 1 / (n * math.e))
    return F.when((n >= 2) & (sr_variance > 0), F.sqrt(sr_variance) * best).otherwise(F.lit(0.0))


def with_deflated_sharpe(rows: DataFrame, n_trials: int = 0, sr_variance: float = 0.0, *, chance: Column | None = None) -> DataFrame:
    """Probability that the true Sharpe beats the best of ``n_trials`` null trials.

    ``chance`` is that best one where it is known already, such as that of ``ledger_trials``.
    """
    if chance is None:
        chance = expected_max_sharpe(F.lit(n_trials), F.lit(sr_variance))
    sr, n = F.col("sr_hat"), F.col("n_obs")
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr))
    z = (sr - F.col("_chance")) * F.sqrt(n - 1) / spread
    # An undefined shape (constant returns) reads as normal.
    filled = rows.withColumns({"skew": F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)),
                               "kurtosis": F.coalesce(F.nanvl("kurtosis", F.lit(3.0)), F.lit(3.0)),
                               "_chance": chance})
    return (filled.withColumn("_z", F.when(n >= 2, z)).withColumn("_p", normal_cdf("_z"))
            .withColumn("deflated_sharpe", F.coalesce("_p", F.lit(0.0))).drop("_z", "_p", "_chance"))


def ledger_trials(ledger: DataFrame) -> dict[str, Column]:
    """Number of trials, Sharpe variance and best Sharpe by chance of a stored ledger (batch, id, sr_hat), as one-row subqueries.

    Every record is a trial.  The variance is carried from batch to batch: half the old one plus half the population
    variance of the batch's Sharpes, to six digits, where a batch has at least two.
    """
    batches = ledger.groupBy("batch").agg(F.count(F.lit(1)).alias("trials"), F.count("sr_hat").alias("n"), F.var_pop("sr_hat").alias("v"))
    # One row per batch from here on.
    listed = batches.agg(F.sum("trials").alias("n_trials"), F.array_sort(F.collect_list(F.struct("batch", "n", "v"))).alias("b"))
    carried = F.aggregate("b", F.lit(0.0), lambda old, b: F.when(b["n"] >= 2, F.round(0.5 * old + 0.5 * b["v"], 6)).otherwise(old))
    numbers = listed.select(F.coalesce("n_trials", F.lit(0)).alias("n_trials"), carried.alias("sr_variance"))
    row = single_row(numbers.withColumn("chance", expected_max_sharpe(F.col("n_trials"), F.col("sr_variance"))))
    return {name: row[name] for name in ("n_trials", "sr_variance", "chance")}


# --- screening, ledger and nominees -----------------------------------------


def screen_and_confirm(train: DataFrame, validate: DataFrame, *, n_trials: int, sr_variance: float,
                       p: ResearchParams = RESEARCH) -> DataFrame:
    """Train metrics of every spec; validate metrics and deflated Sharpe where train passes."""
    names = ["sharpe", "ret", "maxdd", "top20", "cv", "trades"]
    spec = ["id", "base", "atoms", "complexity", "core_key"]
    left = train.select(*spec, *[F.col(c).alias(f"train_{c}") for c in names])
    right = with_deflated_sharpe(validate, n_trials, sr_variance).select(
        "id", *[F.col(c).alias(f"val_{c}") for c in names], "sr_hat", "deflated_sharpe")
    passed = left.where(F.col("train_sharpe") >= p.train_screen_sharpe).select("id")
    return left.join(right.join(passed, "id", "left_semi"), "id", "left")


def upsert_ledger(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """New records replace stored ones with the same id."""
    kept = ledger.join(records.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(records, allowMissingColumns=True)


def updated_sharpe_variance(records: DataFrame, old: float) -> DataFrame:
    """Half the old variance plus half the population variance of the new validate Sharpes."""
    return records.agg(F.count("sr_hat").alias("n"), F.var_pop("sr_hat").alias("v")).select(
        F.when(F.col("n") >= 2, F.round(0.5 * F.lit(old) + 0.5 * F.col("v"), 6)).otherwise(F.lit(old))
        .alias("sr_variance"))


OBJECTIVES = {"val_sharpe": 1, "val_ret": 1, "val_maxdd": 1, "val_top20": -1, "val_cv": -1}


FRONTIER_BLOCK = 4096


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points some row of ``by`` equals or exceeds in every objective and exceeds in one."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), 64):
        some = points[at:at + 64, None, :]
        out[at:at + 64] = ((by >= some).all(axis=2) & (by > some).any(axis=2)).any(axis=1)
    return out


def _own_frontier(points: np.ndarray, block: int) -> np.ndarray:
    """Places of the points that no other of ``points`` beats: strongest sums first, against those kept so far."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), block):
        some = order[at:at + block]
        some = some[~_beaten(points[some], points[kept])]
        kept = np.concatenate([kept, some[~_beaten(points[some], points[some])]])
    return kept


def _points(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def pareto_frontier(records: DataFrame, objectives: Mapping[str, int] = OBJECTIVES, *,
                    key: str = "id", block: int = FRONTIER_BLOCK) -> DataFrame:
    """Records no other record beats in one objective without losing in another.

    What beats a record has a larger sum of objectives.  So the ``block`` records of largest sums come first: their
    own frontier, which is sent to every task, leaves few others.  These are ordered by the first objective and cut
    into blocks, which drop what they beat themselves.  A block then meets only those whose largest values reach its
    smallest in every objective; a frontier may still be the whole input, and no task holds more than two blocks.
    """
    values = F.array(*[(F.coalesce(F.col(n), F.lit(1.0) if s < 0 else F.lit(0.0)) * s).cast("double") for n, s in objectives.items()])
    pts = records.where(F.col("val_trades") > 0).select(F.col(key).cast("string").alias(key), values.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    strongest = pts.orderBy(total.desc(), key).limit(block).select("p").toArrow()  # at most ``block`` rows
    first = np.array(strongest.column("p").to_pylist(), float).reshape(strongest.num_rows, len(objectives))
    first = pts.sparkSession.sparkContext.broadcast(first[_own_frontier(first, 512)])

    def unbeaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_beaten(_points(batch, "p"), first.value)))

    left = pts.mapInArrow(unbeaten, f"{key} string, p array<double>")
    left = written(left.repartitionByRange(F.col("p")[0], F.col("p")[1], key).withColumn("part", F.spark_partition_id()), "frontier")
    names = [f"p{i}" for i in range(len(objectives))]
    box = ", ".join(f"low_{n} double, high_{n} double" for n in names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                points = _points(some, "p")
                kept = _own_frontier(points, 512)
                some, points = some.take(pa.array(kept)), points[kept]
                lists = [pa.array([some.column(0).to_pylist()], pa.list_(pa.string())), pa.array([points.ravel()], pa.list_(pa.float64()))]
                bounds = [pa.array([edge], pa.float64()) for c in range(points.shape[1]) for edge in (points[:, c].min(), points[:, c].max())]
                yield pa.RecordBatch.from_arrays([*lists, *bounds], [key + "s", "ps", *[f"{e}_{n}" for n in names for e in ("low", "high")]])

    packed = left.select(key, "p").mapInArrow(blocks, f"{key}s array<string>, ps array<double>, {box}")
    packed = written(packed.withColumn("block", F.monotonically_increasing_id()), "frontier-blocks")
    ours, theirs = packed.alias("x"), packed.alias("y")
    reach = [F.col(f"y.high_{n}") >= F.col(f"x.low_{n}") for n in names]
    # Blocks are few; their points follow once the boxes have told which of them meet.
    meets = ours.select("block", *[f"low_{n}" for n in names]).alias("x").join(
        theirs.select("block", *[f"high_{n}" for n in names]).alias("y"), reduce(and_, reach, F.col("x.block") != F.col("y.block")))
    meets = meets.select(F.col("x.block").alias("block"), F.col("y.block").alias("other"))
    pairs = (meets.join(packed.select("block", f"{key}s", "ps"), "block")
             .join(packed.select(F.col("block").alias("other"), F.col("ps").alias("others")), "other"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, points, others = (batch.column(c)[at].values for c in (f"{key}s", "ps", "others"))
                shape = (-1, len(names))
                lost = _beaten(points.to_numpy().reshape(shape), others.to_numpy().reshape(shape))
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(lost))], [key])

    lost = pairs.select(f"{key}s", "ps", "others").mapInArrow(compared, f"{key} string").distinct()
    return packed.select(F.explode(f"{key}s").alias(key)).join(lost, key, "left_anti")


def nominees(records: DataFrame, incumbents: DataFrame, frontier: DataFrame,
             p: ResearchParams = RESEARCH) -> DataFrame:
    """Frontier records that clear every gate, with the reason for those that do not."""
    best = single_row(incumbents.agg(
        F.greatest(F.coalesce(F.max("val_sharpe"), F.lit(0.0)), F.lit(0.0)).alias("sharpe")))["sharpe"]
    cores = incumbents.select("core_key").distinct().withColumn("_old", F.lit(True))
    on_front = records.join(frontier, "id", "left_semi").where(F.col("deflated_sharpe") >= p.dsr_pass)
    rows = on_front.join(cores, "core_key", "left").withColumn("_best", best)
    reason = (F.when(F.col("val_trades") < p.min_validate_trades, "too few validate trades")
              .when(F.col("_old"), "variant of an existing core")
              .when(F.col("val_sharpe") < F.col("_best") + p.nominee_margin, "no margin over the best incumbent"))
    return rows.select("id", "val_sharpe", "val_trades", "deflated_sharpe", reason.alias("rejected_because"))


def next_stall_counter(current: int, gated: DataFrame) -> DataFrame:
    return gated.agg(F.count_if(F.col("rejected_because").isNull()).alias("n")).select(
        F.when(F.col("n") > 0, F.lit(0)).otherwise(F.lit(current + 1)).alias("stall_counter"))


def lever_grid(spark: SparkSession, atom_sets: Sequence[Sequence[str]], hold_days: Sequence[int], exits: Sequence[str],
               sizes: Sequence[tuple], window: str) -> DataFrame:
    """Every atom set with every hold length, set of exits and sizing."""
    rows = [(f"a{a}_h{h}_e{e}_s{s}", DEFAULT_BASE, list(names), h, window, [x for i, x in enumerate(exits) if e >> i & 1], size)
            for a, names in enumerate(atom_sets) for h in hold_days for e in range(1 << len(exits)) for s, size in enumerate(sizes)]
    return spark.createDataFrame(rows, LEVER_SCHEMA)


def spec_grid(spark: SparkSession, atoms: Sequence[str], hold_days: Sequence[int], window: str) -> DataFrame:
    """Every atom subset with every hold length."""
    rows = [(f"m{m}_h{h}", DEFAULT_BASE, [a for i, a in enumerate(atoms) if m >> i & 1], h, window)
            for m in range(1 << len(atoms)) for h in hold_days]
    return spark.createDataFrame(rows, SPEC_SCHEMA)
