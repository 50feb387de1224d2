"""Identity, time, money, ratio and verdict expressions."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot import config
from earshot.functions.text import _col


# -- identity ---------------------------------------------------------------------------------
def _digest(parts: Column, n: int) -> Column:
    return F.substring(F.sha2(parts, 256), 1, n)


def _two_lines(first, second) -> Column:
    return F.concat(_col(first), F.lit("\n"), _col(second))


def mention_id(source, key) -> Column:
    """F04. 24 hex of source and key; pass the first non-null of id, url and text key."""
    return _digest(_two_lines(source, key), 24)


def author_hash(source, handle) -> Column:
    """F05. 16 hex; the handle itself is never kept."""
    return _digest(_two_lines(source, handle), 16)


def embedding_key(model: str, text) -> Column:
    """J04. 24 hex of model and text."""
    return _digest(_two_lines(F.lit(model), text), 24)


def input_digest(struct: Column) -> Column:
    """F06. 24 hex over compact JSON; give the struct's fields in name order, at every level."""
    return _digest(F.to_json(struct, {"ignoreNullFields": "false"}), 24)


def engagement_score(engagement) -> Column:
    """F12. Sum of the values, 0 for an empty map."""
    return F.aggregate(
        F.map_values(_col(engagement)), F.lit(0).cast("long"), lambda total, v: total + v
    )


def expected_cluster_key(source, mention, author) -> Column:
    """F13. The resampling unit where it follows from the row itself, else null."""
    source = _col(source)
    return F.when(source.isin(*config.MENTION_CLUSTER_SOURCES), _col(mention)).when(
        source.isin(*config.AUTHOR_CLUSTER_SOURCES), F.coalesce(_col(author), _col(mention))
    )


def cluster_key(source, mention, author, parent) -> Column:
    """F13. Unit of any source: derived, or the parent id, or the mention as a fallback."""
    return F.coalesce(expected_cluster_key(source, mention, author), _col(parent), _col(mention))


def cluster_key_fell_back(source, parent) -> Column:
    """F13. True where a thread source had no parent id."""
    return _col(source).isin(*config.THREAD_SOURCES) & _col(parent).isNull()


# -- time -------------------------------------------------------------------------------------
def window_bounds(now: datetime) -> tuple[datetime, datetime, datetime]:
    """Start, split and end of the 14-day window that ``now`` closes."""
    end = now.replace(microsecond=0)
    return (
        end - timedelta(days=config.WINDOW_DAYS),
        end - timedelta(days=config.SPLIT_DAYS),
        end,
    )


def period_of(ts, now: datetime) -> Column:
    """F15. current, previous or null; half-open at the right."""
    ts = _col(ts)
    start, split, end = (F.lit(f"{b:%Y-%m-%d %H:%M:%S}").cast("timestamp") for b in window_bounds(now))
    return F.when((ts >= split) & (ts < end), "current").when(
        (ts >= start) & (ts < split), "previous"
    )


def utc_day(ts) -> Column:
    """F16. Calendar day; the session time zone is UTC."""
    return F.to_date(_col(ts))


def parse_timestamp(value) -> Column:
    """F32. ISO text (no zone means UTC) or epoch seconds or milliseconds, in a string column."""
    value = F.trim(_col(value))
    number = value.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000.0).otherwise(number)
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), value.try_cast("timestamp"))
    return F.coalesce(iso, F.timestamp_micros(F.floor(seconds * 1000000).cast("long")))


# -- ratios -----------------------------------------------------------------------------------
def ratio(num, den) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def net(pos, neg, neu) -> Column:
    """F27."""
    pos, neg, neu = _col(pos), _col(neg), _col(neu)
    return ratio(pos - neg, pos + neg + neu)


def design_effect(lo, hi, iid_lo, iid_hi) -> Column:
    """F35. Squared ratio of interval widths, null when the row-level interval has no width."""
    iid = _col(iid_hi) - _col(iid_lo)
    quotient = F.try_divide(_col(hi) - _col(lo), iid)
    return quotient * quotient


def event_threshold(median, mad) -> Column:
    """F26."""
    return F.greatest(
        F.lit(float(config.EVENT_MIN_COUNT)),
        _col(median) + config.EVENT_MAD_MULTIPLIER * _col(mad),
    )


def round_half_up(value, places: int) -> Column:
    """F23. Of a decimal column."""
    return F.round(_col(value), places)


# -- money ------------------------------------------------------------------------------------
def estimate_usd(profile: str) -> Column:
    """F20. Planned cost of one source and brand, over the source-plan columns."""
    cap = F.col(f"cap_{profile}")
    by_result = F.col("cap_unit") == "results"
    calls = F.when(by_result, F.lit(1)).otherwise(cap)
    results = F.when(by_result, cap).otherwise(F.lit(0))
    return F.when(cap == 0, F.lit(0.0)).otherwise(
        calls * F.col("per_call_usd") + results * F.col("per_result_usd") + F.col("lookup_usd")
    )


def unit_cost(n_results) -> Column:
    """F20. Cost of one call that returned ``n_results``."""
    return F.col("per_call_usd") + _col(n_results) * F.col("per_result_usd")


def price_usage(tokens_in, cached, tokens_out) -> Column:
    """F21. USD of one call over the joined rate columns; an unknown model is an error."""
    tokens_in, cached, tokens_out = _col(tokens_in), _col(cached), _col(tokens_out)
    cost = (
        (tokens_in - cached) * F.col("input_usd")
        + cached * F.col("cached_usd")
        + tokens_out * F.col("output_usd")
    ) / 1000000.0
    return F.when(F.col("input_usd").isNull(), F.raise_error(F.lit("no rate for this model")).cast("double")).otherwise(cost)


# -- verdicts and states ------------------------------------------------------------------------
def ci_sign(lo, hi) -> Column:
    """+1 or -1 when the interval excludes 0, else 0."""
    return F.when(_col(lo) > 0, 1).when(_col(hi) < 0, -1).otherwise(0)


def wow_verdict(delta, lo, hi, conf_lo, conf_hi, p_raw, p_holm, share) -> Column:
    """F28. ABSTAIN, then SIGNIFICANT, then SUGGESTIVE, then NO_CHANGE_DETECTED."""
    delta, p_raw, p_holm, share = _col(delta), _col(p_raw), _col(p_holm), _col(share)
    full, confirmed = ci_sign(lo, hi), ci_sign(conf_lo, conf_hi)
    has_confirmed = _col(conf_lo).isNotNull()
    clash = has_confirmed & (full * confirmed == -1)
    backed = has_confirmed & (delta != 0) & (confirmed == F.signum(delta))
    return (
        F.when(clash, "ABSTAIN")
        .when((p_holm < config.ALPHA) & (share | backed), "SIGNIFICANT")
        .when(p_raw < config.ALPHA, "SUGGESTIVE")
        .otherwise("NO_CHANGE_DETECTED")
    )


def receipt_verdict(replay, all_reconciled, n_unmatched) -> Column:
    """F29."""
    return (
        F.when(_col(replay), "REPLAY")
        .when(_col(all_reconciled) & (_col(n_unmatched) == 0), "RECONCILED")
        .otherwise("PARTIAL")
    )


def abstain_reason(status, http_status) -> Column:
    """F30. Why a run gave no rows; null when it did its work."""
    status = F.upper(_col(status))
    return (
        F.when(status.isin("LOCAL_DEADLINE", "TIMED_OUT"), "deadline")
        .when(status.isin("LOCAL_BACKOFF_EXHAUSTED", "LOCAL_REJECTED_429"), "rate_limited")
        .when(status == "LOCAL_REJECTED_402", "halted")
        .when(is_failed(status), "provider_failed")
        .when(_col(http_status) >= 400, "provider_failed")
    )


def is_failed(status) -> Column:
    """F31."""
    status = _col(status)
    return status.startswith("LOCAL_") | F.upper(status).isin(*config.FAILED_RUN_STATUSES)


# -- vectors ------------------------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def unit_vector(vector) -> Column:
    """F33. Scaled to length one; the zero vector stays."""
    vector = _col(vector)
    length = F.sqrt(dot(vector, vector))
    divisor = F.when(length == 0, 1.0).otherwise(length)
    # In an array of its own the length is taken once, not again for each number.
    return F.transform(F.array(divisor), lambda by: F.transform(vector, lambda x: x.cast("double") / by))[0]


def cosine_distance(a, b) -> Column:
    """F34. Of two unit vectors, clipped to [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - dot(a, b)))
