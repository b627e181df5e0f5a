"""Content hashes, times, costs and retry rules as column functions."""

from __future__ import annotations

import hashlib
import json
import re
import secrets
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

RUN_ID = r"^[0-9]{4}(?:-[0-9]{2}){2}T[0-9]{2}(?:-[0-9]{2}){2}Z-[a-f0-9]{6}$"


def text_hash(x) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(F.encode(_c(x), "UTF-8"), 256)


def schema_hash(schema: dict) -> str:
    return hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()


def cache_key(*parts) -> Column:
    """16 hex digits over the parts, which are kept apart by NUL; a null part counts as an empty one."""
    return F.left(F.sha2(F.encode(F.concat_ws("\0", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), "UTF-8"), 256), F.lit(16))


def prompt_hash(body) -> Column:
    """8 hex digits over a prompt whose lines are stripped at their right and all end in a line feed."""
    text = F.regexp_replace(_c(body), r"\r?\n$", "")
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.concat(F.regexp_replace(x, r"\s+$", ""), F.lit("\n")))
    return F.left(F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256), F.lit(8))


def run_id(now: datetime | None = None) -> str:
    return f"{(now or datetime.now(UTC)).isoformat(timespec='seconds')[:19].replace(':', '-')}Z-{secrets.token_hex(3)}"


def is_run_id(x) -> Column:
    return _c(x).rlike(RUN_ID)


def render(template: str, values: dict[str, str]) -> str:
    """Fill in <<name>>; an unknown name is an error."""
    return re.sub(r"<<\s*(\w+)\s*>>", lambda m: values[m.group(1)], template)


def template_names(template: str) -> set[str]:
    return set(re.findall(r"<<\s*(\w+)\s*>>", template))


def instant(ts) -> Column:
    """Timestamp of an ISO text with Z, an offset or neither (then UTC); null when it is none. The session is in UTC."""
    return F.try_to_timestamp(F.regexp_replace(_c(ts), r"^([0-9]{4}(?:-[0-9]{2}){2})[ T]", "$1T"))


def week_of(ts) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", _c(ts)).cast("date")


def since(ts, now, days: int) -> Column:
    return _c(ts) >= _c(now) - F.expr(f"INTERVAL {int(days)} DAYS")


def is_stale(captured, today, window_days) -> Column:
    return F.datediff(_c(today), _c(captured)) > window_days


def cost(input_tokens, output_tokens, input_price, output_price) -> Column:
    """USD at prices per million tokens; null when a price is."""
    return (_c(input_tokens) * _c(input_price) + _c(output_tokens) * _c(output_price)) / 1_000_000


ESTIMATE_NOTE = "an estimate from a dated price table and no quote; the real cost depends on model, caching and the provider's prices"


def cost_text(calls, usd, price_date, stale) -> Column:
    """Message about an estimate, with or without a known price."""
    known = F.format_string("Estimated cost: $%.2f USD (%d calls, prices of %s)", _c(usd), _c(calls), _c(price_date))
    message = F.when(_c(usd).isNull(), F.format_string("Estimated cost: %d calls (no price for this model)", _c(calls))).otherwise(known)
    return F.concat(message, F.when(_c(stale), " WARNING: the prices may be stale.").otherwise(""), F.lit(f" - {ESTIMATE_NOTE}"))


def backoff(attempts: int, base: float = 1.0, most: float = 30.0) -> list[float]:
    return [min(base * 2**k, most) for k in range(attempts)]


def backoff_column(attempts) -> Column:
    return F.when(_c(attempts) > 0, F.transform(F.sequence(F.lit(0), _c(attempts) - 1), lambda k: F.least(F.pow(F.lit(2.0), k), F.lit(30.0)))).otherwise(F.array().cast("array<double>"))


def error_class(status, exception=None) -> Column:
    """Class of a failed call: by the name of its exception, else by its HTTP status."""
    name = F.coalesce(_c(exception) if exception is not None else F.lit(None).cast("string"), F.lit(""))
    by_name = {"ValidationError|OutputParserException": "schema_validation", "RateLimit|InternalServer|APIConnection|APITimeout": "transient", "BadRequest": "bad_input", "Authentication": "auth", "PermissionDenied": "content_policy"}
    out = F.when(_c(status).isin(429, 500, 502, 503, 504), "transient").when(_c(status) == 400, "bad_input").when(_c(status).isin(401, 403), "auth").otherwise("unclassified")
    for pattern, kind in reversed(by_name.items()):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return out


def retry_after(header) -> Column:
    """Seconds of a Retry-After header; dates and negative numbers are null."""
    return F.when(_c(header).rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(_c(header)).try_cast("double"))
