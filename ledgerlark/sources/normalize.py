"""Raw provider messages to canonical billing events, with a rejected side.

One projection per stage, no Python per row. A message is read once as a map of
its top-level keys to text (inner blocks keep their JSON text and are read the
same way), so "key missing" and "key null" stay distinct. The first failed
check of a message becomes its ``error``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CANONICAL_FIELDS, PROVIDERS, REQUIRED_FIELDS, IngestLimits
from ..functions.exprs import iso_timestamp, number, staged, text_or_null

_TEXTS = "map<string,string>"


def _object(text: Column) -> Column:
    """JSON object as a key-to-text map; NULL for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _TEXTS))


def _items(text: Column) -> Column:
    """JSON array as its elements' texts; NULL for anything else."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _key(obj: Column, name: str) -> Column:
    return F.try_element_at(obj, F.lit(name))


# -- field checks ----------------------------------------------------------------
#
# Work proceeds in stages of named columns. A column used more than once is
# computed once: the optimizer does not inline it into the next projection.


def _error(*pairs: tuple[Column, str]) -> Column:
    out = F.when(pairs[0][0], F.lit(pairs[0][1]))
    for cond, message in pairs[1:]:
        out = out.when(cond, F.lit(message))
    return out


def amount_error(text: Column, parsed: Column, name: str, required: bool) -> Column:
    checks = [(text.isNull(), f"{name} is required.")] if required else []
    return _error(*checks, (text.isNotNull() & parsed.isNull(), f"{name} must be numeric."),
                  (parsed < 0, f"{name} must be non-negative."))


def text_error(text: Column, name: str) -> Column:
    return _error((text.isNull(), f"{name} is required."), (text_or_null(text).isNull(), f"{name} must not be empty."))


def timestamp_error(text: Column, parsed: Column) -> Column:
    return _error(
        (text.isNull(), "timestamp is required."),
        (F.trim(text) == "", "timestamp must not be empty."),
        (parsed.isNull(), "timestamp must be a valid ISO-8601 value."),
    )


def text_map(obj: Column) -> Column:
    """Object as a map of texts; NULL when empty."""
    return F.when(F.size(obj) > 0, F.transform_values(obj, lambda _, x: F.coalesce(x, F.lit("None"))))


def tags_error(text: Column, obj: Column) -> Column:
    return _error(((text != "") & obj.isNull(), "tags must be a key-value mapping."))


def event_id(text: Column, raw: Column) -> Column:
    """Given id, or a hash of the payload so that re-runs agree."""
    return F.when(F.trim(text) != "", text).otherwise(F.sha2(raw, 256))


def label_objects(text: Column) -> Column:
    """JSON array of label objects as maps; NULL when the text is no array.

    An array with elements that are no objects takes the slower item-wise path.
    """
    whole = F.from_json(text, "array<map<string,string>>")
    return F.when(F.ltrim(text).startswith("["), F.coalesce(whole, F.transform(_items(text), _object)))


def named_labels(objects: Column) -> Column:
    """The entries of ``[{key, value}, ...]`` that have a key as ``{k, v}``, last one first."""
    named = F.reverse(F.filter(objects, lambda o: _key(o, "key").isNotNull()))
    return F.transform(named, lambda o: F.struct(_key(o, "key").alias("k"), F.when(
        F.map_contains_key(o, "value"), F.coalesce(_key(o, "value"), F.lit("None"))).otherwise(F.lit("")).alias("v")))


def label_map(named: Column, keys: Column) -> Column:
    """Named labels and their keys to a map; the last entry of a repeated key wins.

    Both must be columns of the row: a lambda evaluates an expression again for
    every element.
    """
    newest = F.filter(named, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.when(F.size(keys) > 0, F.map_from_entries(newest))


# -- record shapes: where each field of a record is found --------------------------

_FLAT = (
    *REQUIRED_FIELDS, "tags", "labels", "cost", "billing_account_id", "project_id", "service_description",
    "location_region", "usage_start_time", "export_time",
)
_BLOCKS = ("service", "location", "project", "usage")


def _t(name: str) -> Column:
    return F.col(f"t_{name}")


def _inside(block: str, name: str) -> Column:
    return _key(F.col(f"o_{block}"), name)


def canonical_shape() -> dict[str, Column]:
    """An already canonical record: every field under its own name."""
    return {
        **{f: _t(f) for f in (*REQUIRED_FIELDS, "tags")},
        "checks": ("timestamp", "account_id", "service", "cost_amount", "usage_amount", "tags"),
    }


def gcp_shape() -> dict[str, Column]:
    """A provider export record, nested or flat, through fallback chains."""
    has_usage = F.col("o_usage").isNotNull()
    no_labels = _t("labels").isNull() | _t("labels").isin("", "0", "false", "[]", "{}")
    inner = _inside("location", "region")
    return {
        "event_id": _t("event_id"),
        "timestamp": F.coalesce(_t("usage_start_time"), _t("export_time"), _t("timestamp")),
        "provider": F.lit("gcp"),
        "account_id": F.coalesce(
            text_or_null(_t("billing_account_id")), text_or_null(_t("account_id")),
            text_or_null(_inside("project", "id")), text_or_null(_t("project_id"))),
        "service": F.coalesce(
            text_or_null(_inside("service", "description")), text_or_null(_t("service_description")),
            F.when(F.col("o_service").isNull(), text_or_null(_t("service")))),
        # an empty inner region falls through to the inner location, a blank one does not
        "region": F.coalesce(
            text_or_null(F.coalesce(F.when(inner != "", inner), _inside("location", "location"))),
            text_or_null(_t("location_region")), text_or_null(_t("region"))),
        "cost_amount": F.coalesce(_t("cost"), _t("cost_amount")),
        "usage_amount": F.when(has_usage, _inside("usage", "amount")).otherwise(_t("usage_amount")),
        "usage_unit": F.when(has_usage, _inside("usage", "unit")).otherwise(_t("usage_unit")),
        "source_type": F.coalesce(_t("source_type"), F.lit("live")),
        "tags": F.when(no_labels, _t("tags")).otherwise(_t("labels")),
        "checks": ("cost_amount", "usage_amount", "timestamp", "account_id", "service", "tags"),
    }


# The extension point: provider name -> record shape.
PROVIDER_SHAPES: dict[str, Callable[[], dict]] = {"gcp": gcp_shape}


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add ``payload`` (key to text) and ``error``; drop empty messages.

    ``value`` may be text or UTF-8 bytes; bytes that are not UTF-8, text that
    is not JSON and JSON that is not an object are rejects.
    """
    df = messages.filter(F.col(value).isNotNull())
    text = F.col(value)
    if dict(df.dtypes)[value] == "binary":
        text = F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))
    df = df.withColumn("_text", text)
    # both parsers ignore what follows an object; enclosed in an array and in
    # another object, no following text is valid twice. Only the variant parser
    # is strict, so a text that the other one takes is read once by each
    listed, inner = F.concat(F.lit("["), "_text", F.lit("]")), F.concat(F.lit('{"x":'), "_text", F.lit("}"))
    loose = F.when(F.try_parse_json(listed).isNotNull() & F.ltrim("_text").startswith("{"), F.from_json(inner, f"x {_TEXTS}")["x"])
    df = df.withColumn("payload", loose)
    return df.withColumn("error", F.when(F.col("payload").isNull(), _error(
        (F.col("_text").isNull(), "payload is not valid UTF-8."),
        (F.try_parse_json(listed).isNull() | F.try_parse_json(inner).isNull(), "payload is not valid JSON."),
        (F.lit(True), "Event payload must be a JSON object."),
    ))).drop("_text")


def missing_required(obj: Column) -> Column:
    """Comma list of required canonical keys absent from a decoded object."""
    return F.array_join(F.array_compact(F.array(*[
        F.when(~F.map_contains_key(obj, f), F.lit(f)) for f in REQUIRED_FIELDS])), ", ")


def looks_canonical(obj: Column) -> Column:
    cond = F.lit(True)
    for f in REQUIRED_FIELDS:
        cond = cond & F.map_contains_key(obj, f)
    return cond


def normalize(messages: DataFrame, value: str = "value") -> DataFrame:
    """Every message once, with canonical columns or an ``error``.

    Keeps the caller's columns (message id, offsets) next to the result; works
    on batch and streaming frames alike.
    """
    df = decode(messages, value)
    obj = F.col("payload")
    provider = _key(obj, "provider")
    df = staged(df, [*messages.columns, "error"], {
        **{f"t_{f}": _key(obj, f) for f in (*_FLAT, "location", "project", "usage")},
        "_canonical": F.coalesce(looks_canonical(obj), F.lit(False)),
        "_provider": F.coalesce(F.lower(F.trim(F.when(provider != "", provider))), F.lit("gcp")),
    })
    df = df.withColumns({f"o_{b}": _object(F.col(f"t_{b}")) for b in _BLOCKS})
    shapes = [(F.col("_canonical"), canonical_shape())]
    shapes += [(F.col("_provider") == name, build()) for name, build in PROVIDER_SHAPES.items()]

    def pick(value_of: Callable[[dict], Column]) -> Column:
        out = F
        for cond, shape in shapes:
            out = out.when(cond, value_of(shape))
        return out

    df = df.withColumns({f"x_{f}": pick(lambda s, f=f: s[f]) for f in CANONICAL_FIELDS})

    def x(name: str) -> Column:
        return F.col(f"x_{name}")

    df = df.withColumns({
        "p_timestamp": iso_timestamp(F.trim(x("timestamp"))),
        "p_cost_amount": number(x("cost_amount")),
        "p_usage_amount": number(x("usage_amount")),
        "o_tags": _object(x("tags")),
        "l_tags": F.when(~F.col("_canonical"), label_objects(x("tags"))),
    })
    df = df.withColumns({
        "e_timestamp": timestamp_error(x("timestamp"), F.col("p_timestamp")),
        "e_account_id": text_error(x("account_id"), "account_id"),
        "e_service": text_error(x("service"), "service"),
        "e_cost_amount": amount_error(x("cost_amount"), F.col("p_cost_amount"), "cost_amount", True),
        "e_usage_amount": amount_error(x("usage_amount"), F.col("p_usage_amount"), "usage_amount", False),
        "e_tags": F.when(F.col("l_tags").isNull(), tags_error(x("tags"), F.col("o_tags"))),
        "l_named": named_labels(F.col("l_tags")),
    })
    df = df.withColumn("l_keys", F.col("l_named")["k"])
    failed = pick(lambda s: F.coalesce(*[F.col(f"e_{c}") for c in s["checks"]])).otherwise(
        F.concat(F.lit("Unsupported provider '"), F.col("_provider"), F.lit("'.")))
    out = {
        "event_id": event_id(x("event_id"), F.col(value).cast("string")),
        "timestamp": F.col("p_timestamp"),
        "provider": F.coalesce(text_or_null(x("provider")), F.lit("gcp")),
        "account_id": F.trim(x("account_id")),
        "service": F.trim(x("service")),
        "region": F.coalesce(text_or_null(x("region")), F.lit("global")),
        "cost_amount": F.col("p_cost_amount"),
        "usage_amount": F.coalesce("p_usage_amount", F.lit(0.0)),
        "usage_unit": F.coalesce(text_or_null(x("usage_unit")), F.lit("unit")),
        "tags": F.when(F.col("l_tags").isNotNull(), label_map(F.col("l_named"), F.col("l_keys"))).otherwise(text_map(F.col("o_tags"))),
        "source_type": F.coalesce(text_or_null(x("source_type")), F.lit("stream")),
    }
    keep = [c for c in messages.columns if c not in out]
    # only the error is a boundary, so that fields nobody asks for are not computed
    used = [c for c in df.columns if (c[:2] in ("x_", "p_", "l_") or c == "o_tags") and c not in messages.columns]
    df = staged(df, [*messages.columns, *used], {"_error": F.coalesce("error", failed)})
    ok = F.col("_error").isNull()
    return df.select(*keep, *[F.when(ok, c).alias(f) for f, c in out.items()], F.col("_error").alias("error"))


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("error").isNull()).select(*CANONICAL_FIELDS)


def rejected(normalized: DataFrame, failed_at: Column, stream: str = "billing-events", value: str = "value",
             message_id: str = "message_id") -> DataFrame:
    """Dead-letter records of the messages that failed."""
    from ..functions.exprs import iso_text

    return normalized.filter(F.col("error").isNotNull()).select(
        iso_text(failed_at).alias("failed_at"),
        F.lit(stream).alias("stream"),
        F.col(message_id).cast("string").alias("message_id"),
        "error",
        F.col(value).cast("string").alias("raw_payload"),
    )


def ingest_errors(events: DataFrame, now: str, limits: IngestLimits = IngestLimits()) -> DataFrame:
    """Strict contract of the ingestion path: adds ``violations`` (array).

    Amounts must have at most six decimals, so they are compared with their
    rounded value.
    """
    scale = limits.decimal_places
    tags_col = F.col("tags") if "tags" in events.columns else F.lit(None).cast("map<string,string>")
    latest = F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {limits.future_skew_seconds} SECONDS")

    def blank(name: str) -> Column:
        return F.when(text_or_null(F.col(name)).isNull(), F.lit(name))

    def bad_amount(name: str) -> Column:
        v = F.col(name).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (v < 0) | (F.abs(v - F.round(v, scale)) > 1e-12 * F.greatest(v, F.lit(1.0))),
                      F.lit(name))

    return events.withColumn("violations", F.array_compact(F.array(
        F.when(F.col("timestamp").isNull() | (F.col("timestamp") > latest), F.lit("timestamp")),
        F.when(F.col("provider").isNull() | ~F.col("provider").isin(*PROVIDERS), F.lit("provider")),
        blank("account_id"), blank("service"), blank("region"),
        bad_amount("cost_amount"), bad_amount("usage_amount"),
        blank("usage_unit"),
        F.when(
            (F.size(F.map_keys(tags_col)) > limits.max_tags)
            | F.exists(F.map_keys(tags_col), lambda k: F.length(k) > limits.max_key)
            | F.exists(F.map_values(tags_col), lambda v: F.length(v) > limits.max_value), F.lit("tags")),
        F.when(F.col("source_type").isNull() | ~F.col("source_type").isin(*limits.sources), F.lit("source_type")),
    )))


def frame_problems(events: DataFrame) -> DataFrame:
    """Schema check of a whole frame: column order and negative amounts.

    One row: ``columns_ok, negative_cost, negative_usage``; one aggregation.
    """
    columns_ok = list(events.columns) == list(CANONICAL_FIELDS)
    return events.agg(
        F.lit(columns_ok).alias("columns_ok"),
        F.count_if(F.col("cost_amount") < 0).alias("negative_cost"),
        F.count_if(F.col("usage_amount") < 0).alias("negative_usage"),
    )
