"""Recomputation, rule, leakage, membership and layout audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import TRADING_DAYS_PER_YEAR, by, finite, safe_div, warnings_array
from tidemark.operators.contracts import resolve_identity
from tidemark.operators.sessions import previous_business_day

REL_TOL, ABS_TOL = 1e-7, 1e-9


def to_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, number, text) rows of a wide table: one explode, no shuffle."""
    kinds = dict(df.dtypes)
    items = []
    for c in columns:
        text = kinds[c] == "string"
        items.append(F.struct(F.lit(c).alias("feature"), (F.lit(None) if text else F.col(c)).cast("double").alias("number"),
                              (F.col(c) if text else F.lit(None)).cast("string").alias("text")))
    return df.select(*keys, F.explode(F.array(*items)).alias("f")).select(*keys, "f.*")


def values_match(a: str, b: str) -> Column:
    """Equal texts, or numbers within relative 1e-7 or absolute 1e-9; null equals null only."""
    x, y = F.col(f"{a}_number"), F.col(f"{b}_number")
    near = F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * REL_TOL, F.lit(ABS_TOL))
    return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(x.isNull() & y.isNull() & F.col(f"{a}_text").eqNullSafe(F.col(f"{b}_text")))


def compare_features(stored: DataFrame, recomputed: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """V1: per (key, feature) status match, mismatch, missing (not stored) or unexpected (not recomputed).

    Both wide rows meet on the key once; the comparison is done on the joined row
    and only then unpivoted.
    """
    keys = keys or ["date", "ticker"]
    s = stored.select(*keys, F.struct(*features).alias("s"))
    r = recomputed.select(*keys, F.struct(*features).alias("r"))
    j = s.join(r, keys, "full")
    kinds = dict(stored.dtypes)
    items = []
    for c in features:
        a, b = F.col(f"s.{c}"), F.col(f"r.{c}")
        if kinds[c] == "string":
            ok = a.eqNullSafe(b)
        else:
            a, b = a.cast("double"), b.cast("double")
            near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * REL_TOL, F.lit(ABS_TOL))
            ok = F.coalesce(near, a.isNull() & b.isNull())
        items.append(F.struct(F.lit(c).alias("feature"), ok.alias("ok")))
    j = j.select(*keys, F.col("s").isNull().alias("_ns"), F.col("r").isNull().alias("_nr"), F.explode(F.array(*items)).alias("f"))
    status = F.when(F.col("_ns"), "missing").when(F.col("_nr"), "unexpected").when(F.col("f.ok"), "match").otherwise("mismatch")
    return j.select(*keys, "f.feature", status.alias("status"))


def branch_status(comparison: DataFrame, owners: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """V1: pass, fail or warn (nothing compared) per key and branch."""
    keys = keys or ["date", "ticker"]
    m = F.create_map(*[F.lit(x) for kv in owners.items() for x in kv])
    g = comparison.withColumn("branch", m[F.col("feature")]).groupBy(*keys, "branch").agg(
        F.count_if(F.col("status").isin("match", "mismatch")).alias("compared"), F.count_if(F.col("status") != "match").alias("problems"))
    return g.withColumn("status", F.when(F.col("problems") > 0, "fail").when(F.col("compared") == 0, "warn").otherwise("pass"))


def rule_violation() -> Column:
    """F16: message when (number, text) breaks the rule columns beside it; null when it does not."""
    null = F.col("number").isNull() & F.col("text").isNull()
    num = F.col("number")
    return (
        F.when(null, F.when(~F.col("nullable"), "null value is not allowed"))
        .when(F.col("kind") == "string", F.when(F.col("text").isNull(), "expected string").when(F.col("allowed").isNotNull() & ~F.coalesce(F.array_contains("allowed", F.col("text")), F.lit(False)), "value not allowed"))
        .when(finite(num).isNull(), "expected number")
        .when(num < F.col("minimum"), "below minimum").when(num > F.col("maximum"), "above maximum"))


def check_rules(features: DataFrame, rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """F16, V2: every feature value with its rule's verdict; unknown names are reported too.

    Rules are as few as columns, so they go to the values: dealt by feature, all rows would meet in a task per feature.
    """
    keys = keys or ["date", "ticker"]
    long = to_long(features, keys, [c for c in features.columns if c not in keys])
    j = long.join(F.broadcast(rules), "feature", "left")
    return j.select(*keys, "feature", "owner", "number", "text", F.when(F.col("owner").isNull(), "unknown feature").otherwise(rule_violation()).alias("message"))


def missing_required(features: DataFrame, rules: DataFrame) -> DataFrame:
    """V2: required rules whose column the table lacks (a property of the schema, so no row is read)."""
    return rules.where("required").where(~F.col("feature").isin([c for c in features.columns])).select("feature", "owner")


def leakage_boundaries(rows: DataFrame, dates: str, as_of: str, keys: list[str]) -> DataFrame:
    """V3: last date before the audit date, first on or after it, and the count of the latter."""
    t = F.lit(as_of).cast("date")
    early, late = F.col(dates) < t, F.col(dates) >= t
    g = rows.groupBy(*keys).agg(F.max(F.when(early, F.col(dates))).alias("latest_prior"), F.min(F.when(late, F.col(dates))).alias("earliest_future"),
                                F.count_if(F.coalesce(late, F.lit(False))).alias("rows_on_or_after"), F.count(F.lit(1)).alias("rows_total"))
    return g.withColumn("status", F.when(F.col("rows_on_or_after") > 0, "warn").otherwise("pass"))


# Checked features and the prior bars each needs.
SPOT_BARS = {"returns_1d": 2, "returns_5d": 6, "realized_vol_21d": 22, "volume_ratio_20": 20, "rsi_14": 15}


def spot_checks(bars: DataFrame, stored: DataFrame, *, absolute: float = ABS_TOL, relative: float = REL_TOL) -> DataFrame:
    """V5: five features of every stored row recomputed from raw prior bars by array functions, beside the stored values.

    A different route than the feature job: the bars before the date are gathered per row (a bounded frame) and
    folded. `raw_inputs` are the (date, value) pairs that went in. A row without a bar, with too few or unusable ones
    (null, not finite), or with an undefined value warns; a stored value that is missing or off fails.

    Stored rows and bars (one a key) meet in one union by ticker, so that no gathered bars are moved. Each fold is a
    column of its own: inside a lambda it would run again for every element.
    """
    most = max(SPOT_BARS.values())
    bar = F.struct("date", finite("adj_close").alias("p"), finite(F.col("volume").cast("double")).alias("v"))
    both = bars.select("ticker", "date", F.lit(0).alias("_side"), bar.alias("_bar")).unionByName(
        stored.select("ticker", "date", F.lit(1).alias("_side"), F.struct(*SPOT_BARS).alias("_row")), allowMissingColumns=True)
    upto = by("ticker", order=["date", "_side"]).rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("*", F.count("_bar").over(upto).alias("_n"), (F.last("_bar", ignorenulls=True).over(upto)["date"] == F.col("date")).alias("_has"))
    # a row's own bar has its number
    both = both.select("*", F.collect_list("_bar").over(by("ticker", order="_n").rangeBetween(-most, -1)).alias("_h")).where(F.col("_side") == 1)
    has = F.col("ticker").isNotNull() & F.coalesce("_has", F.lit(False))
    rows = both.select("ticker", "date", "_row.*", has.alias("_has"), "_h", F.when(has, F.size("_h")).otherwise(0).alias("_have"))

    value_of = lambda c: lambda x: x[c]
    input_of = lambda c: lambda x: F.struct(x["date"].alias("date"), x[c].alias("value"))

    def mean(xs: str, n: int) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n

    def with_folds(df: DataFrame, **folds: Column) -> DataFrame:
        return df.select("*", *[c.alias(name) for name, c in folds.items()])

    value = {name: "v" if name.startswith("volume") else "p" for name in SPOT_BARS}
    rows = with_folds(rows, **{f"_part_{name}": F.when(F.col("_have") >= n, F.slice("_h", -n, n)) for name, n in SPOT_BARS.items()}).drop("_h")
    rows = with_folds(rows, **{f"_all_{name}": F.transform(f"_part_{name}", value_of(c)) for name, c in value.items()})
    # the values only where all are usable
    rows = with_folds(rows, **{f"_x_{name}": F.when(~F.exists(f"_all_{name}", lambda x: x.isNull()), F.col(f"_all_{name}")) for name in SPOT_BARS})
    steps = lambda name, f: F.zip_with(F.slice(f"_x_{name}", 1, SPOT_BARS[name] - 1), F.slice(f"_x_{name}", 2, SPOT_BARS[name] - 1), f)
    moves, days = SPOT_BARS["rsi_14"] - 1, SPOT_BARS["realized_vol_21d"] - 1
    rows = with_folds(rows, _r=steps("realized_vol_21d", lambda a, c: safe_div(c, a) - 1.0), _d=steps("rsi_14", lambda a, c: c - a))
    rows = with_folds(rows, _m=mean("_r", days), _gains=F.transform("_d", lambda x: F.greatest(x, F.lit(0.0))), _losses=F.transform("_d", lambda x: F.greatest(-x, F.lit(0.0))))
    square = F.aggregate("_r", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    rows = with_folds(rows, _square=square, _up=mean("_gains", moves), _down=mean("_losses", moves), _volume=mean("_x_volume_ratio_20", SPOT_BARS["volume_ratio_20"]))
    up, down = F.col("_up"), F.col("_down")
    change = lambda name: safe_div(F.element_at(f"_x_{name}", SPOT_BARS[name]), F.element_at(f"_x_{name}", 1)) - 1.0
    expected = {
        "returns_1d": change("returns_1d"), "returns_5d": change("returns_5d"),
        "realized_vol_21d": F.sqrt(F.col("_square") / (days - 1)) * F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR))),
        "volume_ratio_20": safe_div(F.element_at("_x_volume_ratio_20", SPOT_BARS["volume_ratio_20"]), F.col("_volume")),
        "rsi_14": F.when((up == 0) & (down == 0), None).when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + safe_div(up, down)))}
    items = []
    for name, n in SPOT_BARS.items():
        reason = F.when(~F.col("_has"), "missing_bar").when(F.col("_have") < n, "insufficient_history").when(F.col(f"_x_{name}").isNull(), "invalid_input")
        items.append(F.struct(
            F.lit(name).alias("feature"), F.col(name).cast("double").alias("stored"), F.when(F.col(f"_x_{name}").isNotNull(), expected[name]).alias("expected"), reason.alias("reason"),
            F.least("_have", F.lit(n)).alias("bar_count"), F.transform(f"_part_{name}", input_of(value[name])).alias("raw_inputs")))
    s = rows.select("ticker", "date", F.explode(F.array(*items)).alias("s")).select("ticker", "date", "s.*")
    gap = F.abs(F.col("stored") - F.col("expected"))
    s = s.select("*", gap.alias("absolute_difference"), (gap / F.greatest(F.abs("expected"), F.lit(absolute))).alias("relative_difference"))
    ok = (F.col("absolute_difference") <= absolute) | (F.col("relative_difference") <= relative)
    return s.withColumns({
        "status": F.when(F.col("expected").isNull(), "warn").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail"),
        "reason": F.coalesce("reason", F.when(F.col("expected").isNull(), "undefined")),
        "window_start": F.try_element_at("raw_inputs", F.lit(1))["date"], "window_end": F.try_element_at("raw_inputs", F.lit(-1))["date"]})


def without_bar(expected: DataFrame, bars: DataFrame) -> DataFrame:
    """V6: eligible (date, ticker) pairs, the benchmark among them, that have no bar."""
    return expected.select("date", "ticker").distinct().join(bars.select("date", "ticker"), ["date", "ticker"], "left_anti")


def deterministic_sample(keys: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """V7: the k keys with the smallest SHA-256 of seed and key text, the same in any engine; a top-k, so no full sort."""
    cols = keys.columns
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)
    return keys.select(*cols, digest.alias("_h")).orderBy("_h", *cols).limit(k).drop("_h")


def membership_events(changes: DataFrame, members: DataFrame) -> DataFrame:
    """Each change beside membership on its day and on the previous business day.

    `members` is (date, ticker) of stored days; a day without any member counts as
    having no file. Symbols are resolved to identities first.
    """
    ev = resolve_identity(changes.withColumnRenamed("ticker", "raw_ticker")).withColumn("prev", previous_business_day("date"))
    ev = ev.select("date", "prev", "action", F.translate(F.upper(F.trim("raw_ticker")), ".", "-").alias("raw_ticker"), "ticker", "reason_code").distinct()
    both = ev.groupBy("date", "ticker").agg((F.count_distinct("action") > 1).alias("self_cancelling"))
    days = members.select("date").distinct()
    m = members.select("date", "ticker").distinct()

    def flag(df: DataFrame, day: str, sym: str, name: str) -> DataFrame:
        right = m.select(F.col("date").alias("_d"), F.col("ticker").alias("_t"), F.lit(True).alias(name))
        return df.join(right, (F.col(day) == F.col("_d")) & (F.col(sym) == F.col("_t")), "left").drop("_d", "_t").withColumn(name, F.coalesce(name, F.lit(False)))

    df = ev.join(both, ["date", "ticker"])
    for day, sym, name in (("date", "ticker", "on_resolved"), ("prev", "ticker", "before_resolved"), ("date", "raw_ticker", "on_raw"), ("prev", "raw_ticker", "before_raw")):
        df = flag(df, day, sym, name)
    df = df.join(days.select(F.col("date"), F.lit(True).alias("_on")), "date", "left").join(days.select(F.col("date").alias("prev"), F.lit(True).alias("_pr")), "prev", "left")
    return df.withColumn("has_files", F.col("_on").isNotNull() & F.col("_pr").isNotNull()).drop("_on", "_pr")


def membership_findings(events: DataFrame) -> DataFrame:
    """V8: per event skipped, resolved, mismatched or consistent, with the reason."""
    on, pre, onr, prer = (F.col(c) for c in ("on_resolved", "before_resolved", "on_raw", "before_raw"))
    alias = F.col("raw_ticker") != F.col("ticker")
    add = F.col("action") == "added"
    good = F.when(add, ~pre & on).otherwise(pre & ~on)
    raw_on = F.when(alias & onr & ~on, "raw_symbol_present_without_resolved_identity_on_event_date")
    raw_pre = F.when(alias & prer & ~pre, "raw_symbol_present_without_resolved_identity_before_event")
    added = F.when(pre & on, "addition_already_present_before_event").when(~pre & ~on, "addition_missing_on_event_date").otherwise("addition_present_before_event_but_missing_on_event_date")
    removed = F.when(~pre & on, "removal_present_only_on_event_date").when(~pre & ~on, "removal_missing_before_event").otherwise("removal_still_present_on_event_date")
    why = F.when(add, F.coalesce(raw_on, raw_pre, added)).otherwise(F.coalesce(raw_pre, raw_on, removed))
    status = F.when(~F.col("has_files") | F.col("self_cancelling"), "skipped").when(good, F.when(alias, "resolved").otherwise("consistent")).otherwise("mismatched")
    reason = (F.when(~F.col("has_files"), "missing_boundary_membership_file").when(F.col("self_cancelling"), "self_canceling_event")
              .when(good, F.when(alias, F.col("reason_code"))).otherwise(why))
    return events.select("date", "action", "raw_ticker", "ticker", status.alias("status"), reason.alias("finding"))


def membership_summary(findings: DataFrame) -> DataFrame:
    """V8: counts and violation rate."""
    n = lambda s: F.count_if(F.col("status") == s)
    checked = F.count_if(F.col("status") != "skipped")
    return findings.agg(checked.alias("checked"), n("mismatched").alias("violations"), n("resolved").alias("resolved"), n("skipped").alias("skipped"),
                        F.coalesce(safe_div(n("mismatched"), checked), F.lit(0.0)).alias("violation_rate"))


def membership_day_checks(rows: DataFrame, days: DataFrame) -> DataFrame:
    """V8: per day members, duplicate tickers and emptiness."""
    per = rows.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("c")).groupBy("date").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("c") > 1).alias("duplicates"))
    return days.select("date").distinct().join(per, "date", "left").na.fill(0, ["members", "duplicates"]).withColumn("empty", F.col("members") == 0)


def provenance_checks(expected: DataFrame, manifest: DataFrame, report: DataFrame) -> DataFrame:
    """V9: (run, field, value) of three sources side by side, with the error each difference means."""
    e, m, r = (df.select("run_id", "field", F.col("value").alias(n)) for df, n in ((expected, "expected"), (manifest, "manifest"), (report, "report")))
    j = e.join(m, ["run_id", "field"], "left").join(r, ["run_id", "field"], "left")
    err = (F.when(F.col("manifest").isNull(), "manifest_field_missing").when(F.col("manifest") != F.col("expected"), "manifest_policy_mismatch")
           .when(F.col("report").isNull(), "report_field_missing").when(F.col("report") != F.col("manifest"), "report_manifest_mismatch"))
    return j.withColumn("error", err)


DATED_KEY = r"^features/(\d{4}-\d{2}-\d{2})/([A-Z0-9.\-]+)\.parquet$"
HISTORY_KEY = r"^features/history/([A-Z0-9.\-]+)\.parquet$"


def classify_keys(listing: DataFrame, key: str = "key") -> DataFrame:
    """Archive keys as dated shard, ticker history or other, with their parts."""
    k = F.col(key)
    dated, hist = k.rlike(DATED_KEY), k.rlike(HISTORY_KEY)
    return listing.select(
        key, F.when(dated, "dated").when(hist, "history").otherwise("other").alias("layout"),
        F.when(dated, F.regexp_extract(k, DATED_KEY, 1).try_cast("date")).alias("date"),
        F.when(dated, F.regexp_extract(k, DATED_KEY, 2)).when(hist, F.regexp_extract(k, HISTORY_KEY, 1)).alias("ticker"))


def layout_inventory(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected date how many tickers are expected, listed and missing."""
    have = classified.where("layout = 'dated'").select("date", "ticker").distinct().withColumn("_h", F.lit(1))
    j = expected.select("date", "ticker").distinct().join(have, ["date", "ticker"], "left")
    return j.groupBy("date").agg(F.count(F.lit(1)).alias("expected"), F.count("_h").alias("listed")).withColumn("missing", F.col("expected") - F.col("listed"))


RUN_FAMILY = r"^(.*?)(?:-v(\d+).*)?$"


def run_families(runs: DataFrame, run_id: str) -> DataFrame:
    """Runs of the same family as run_id (same name before -vN), their role and staleness."""
    fam = lambda c: F.regexp_extract(c, RUN_FAMILY, 1)
    same = runs.where(fam(F.col("run_id")) == fam(F.lit(run_id)))
    exact = F.col("run_id") == run_id
    return same.select("run_id", fam(F.col("run_id")).alias("family"), F.regexp_extract("run_id", RUN_FAMILY, 2).try_cast("int").alias("version"), "status", "finished_at",
                       exact.alias("exact"), (~exact & (F.col("status") == "running")).alias("stale"))


def evaluation_scope(requested: DataFrame, observed: DataFrame, dropped: DataFrame) -> DataFrame:
    """Requested and observed dates compared, with the distinct dropped columns as one short list."""
    r, o = requested.select("date").distinct(), observed.select("date").distinct()
    j = r.withColumn("_r", F.lit(True)).join(o.withColumn("_o", F.lit(True)), "date", "full")
    one = j.agg(F.count("_r").alias("requested"), F.count("_o").alias("observed"), F.count_if(F.col("_o").isNull()).alias("missing"), F.count_if(F.col("_r").isNull()).alias("unexpected")).withColumn("_j", F.lit(0))
    d = dropped.select("column").distinct().agg(F.array_sort(F.collect_list("column")).alias("dropped_columns")).withColumn("_j", F.lit(0))
    out = one.join(d, "_j").drop("_j")
    return out.withColumn("warnings", warnings_array((F.col("missing") > 0, "missing_dates"), (F.col("unexpected") > 0, "unexpected_dates"), (F.size("dropped_columns") > 0, "dropped_columns")))


def artifact_checks(rows: DataFrame) -> DataFrame:
    """(date, ticker) keys with rows outside their artifact's date or repeated within or across artifacts."""
    g = rows.groupBy("date", "ticker", "artifact_date").agg(F.count(F.lit(1)).alias("c")).groupBy("date", "ticker").agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("artifacts"), F.max("c").alias("most"), F.sum(F.when(F.col("date") != F.col("artifact_date"), F.col("c")).otherwise(0)).alias("foreign_rows"))
    return g.select("date", "ticker", "rows", "artifacts", "foreign_rows", (F.col("most") > 1).alias("duplicate_in_artifact"), (F.col("artifacts") > 1).alias("duplicate_across_artifacts"))


def regime_diagnostic(dates: DataFrame, runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The first reason on the chain per date, status and whether the regime is required.

    `runs`: one row per date (valid, stage, status, output_path, expected_path, infers_date);
    `outputs`: one row per date (readable_columns, row_count, populated, required).
    """
    j = dates.select("date").distinct().join(runs, "date", "left").join(outputs, "date", "left")
    reason = (
        F.when(F.col("valid").isNull(), "missing_regime_manifest").when(~F.col("valid"), "invalid_regime_manifest")
        .when(F.col("stage") != "layer1_5_regime", "regime_manifest_stage_mismatch").when(F.col("status") != "completed", "regime_manifest_not_completed")
        .when(F.col("output_path") != F.col("expected_path"), "regime_manifest_output_mismatch").when(~F.col("infers_date"), "regime_manifest_missing_inference_date")
        .when(F.col("row_count").isNull(), "missing_regime_output").when(~F.col("has_columns"), "regime_output_missing_columns")
        .when(F.col("row_count") != 1, "regime_output_row_count_mismatch").when(F.col("required") & ~F.col("populated"), "required_regime_output_is_null"))
    need = F.when(reason.isNull() | (reason == "required_regime_output_is_null"), F.coalesce("required", F.lit(False))).otherwise(F.lit(False))
    return j.select("date", F.coalesce(reason, F.when(need, "ready").otherwise("legacy_missing_diagnostics")).alias("reason"),
                    F.when(reason.isNotNull(), "failure").when(need, "ready").otherwise("warning").alias("regime_status"), need.alias("required_for_ranker"))


def stored_row_counts(audited: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows per audited (ticker, date): exactly one, none or several."""
    c = stored.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("rows"))
    j = audited.select("ticker", "date").distinct().join(c, ["ticker", "date"], "left").na.fill(0, ["rows"])
    return j.withColumn("finding", F.when(F.col("rows") == 0, "missing").when(F.col("rows") > 1, "several").otherwise("ok"))
