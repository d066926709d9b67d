"""Positioned text lines: order, checks, bands and the joins that make records of them.

``lines`` has ``document_token, page_number, line_index, text, bbox`` (four points) and what a function names. Rows
with one document and index count once (``reading_order``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.functions.values import day_marker, finite_number, first_number, grams_per_litre, last_number_before, moment_of, row_id, unit_key

#: Units that end or make a line.
UNIT_LINE = r"^(?:[mµμun]?mol/L|[mµμun]?g/d?L|k?U/L|10\^\d+/L|10⁹/L|%|mmHg|kPa|°C|cm|kg)$"
UNIT_PATTERN = r"(?:[mµμun]?mol/L|[mµμun]?g/d?L|k?U/L|10\^\d+/L|10⁹/L)"
NUMBER_LINE = r"^[<>≤≥]?\d+(?:[.,]\d+)?$"
RANGE_LINE = r"^\d+(?:[.,]\d+)?-\d+(?:[.,]\d+)?$"


def reading_order(lines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Each line of each document once; of rows that differ the greatest by text counts. Null texts are empty."""
    kept = ("text", "page_number", "bbox", *extra)
    one = lines.select("document_token", F.col("line_index").cast("int").alias("line_index"), *kept).groupBy("document_token", "line_index").agg(F.max(F.struct(*kept)).alias("v")).select("document_token", "line_index", "v.*")
    return one.withColumn("text", F.coalesce("text", F.lit("")))


def extents(bbox: Column) -> dict[str, Column]:
    """Left, top and bottom of a box; null for a box without points or with a value that is no number."""
    sound = (F.size(bbox) > 0) & F.forall(bbox, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    x, y = F.transform(bbox, lambda p: p[0]), F.transform(bbox, lambda p: p[1])
    return {"left": F.when(sound, F.array_min(x)), "top": F.when(sound, F.array_min(y)), "bottom": F.when(sound, F.array_max(y))}


def page_ranges(lines: DataFrame) -> DataFrame:
    return reading_order(lines).groupBy("document_token").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count(F.lit(1)).alias("line_count"))


def structure_violations(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, code`` of what breaks a document's structure.

    DUPLICATE_LINE (a row again), PAGE_DECREASES and PAGE_SKIPPED against the line before, INDEX_GAP, BBOX_INVALID,
    CONFIDENCE_MISSING and CONFIDENCE_OUT_OF_RANGE.
    """
    twice = lines.groupBy("document_token", F.col("line_index").cast("int").alias("line_index")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("document_token", "line_index", F.lit("DUPLICATE_LINE").alias("code"))
    one = reading_order(lines, ("confidence",))
    order = Window.partitionBy("document_token").orderBy("line_index")
    step, page = F.col("line_index") - F.lag("line_index").over(order), F.col("page_number") - F.lag("page_number").over(order)
    seen = one.withColumns({"step": step, "turn": page} | extents(F.col("bbox")))
    codes = F.array_compact(F.array(
        F.when(F.col("turn") < 0, "PAGE_DECREASES"), F.when(F.col("turn") > 1, "PAGE_SKIPPED"), F.when(F.coalesce("step", F.col("line_index") + 1) != 1, "INDEX_GAP"),
        F.when(F.col("top").isNull(), "BBOX_INVALID"), F.when(F.col("confidence").isNull() | F.isnan("confidence"), "CONFIDENCE_MISSING").when(~F.col("confidence").between(0, 1), "CONFIDENCE_OUT_OF_RANGE"),
    ))
    return twice.unionByName(seen.select("document_token", "line_index", F.explode(codes).alias("code")))


def alignment_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per document: lines on both sides, on one side only, and at another place; places compare at a thousandth."""
    place = lambda: F.transform("bbox", lambda p: F.transform(p, lambda v: F.round(v, 3)))
    side = lambda df, x: reading_order(df).select("document_token", "line_index", F.col("page_number").alias(f"page_{x}"), place().alias(f"box_{x}"))
    both = side(left, "a").join(side(right, "b"), ["document_token", "line_index"], "full_outer")
    in_a, in_b = F.col("page_a").isNotNull(), F.col("page_b").isNotNull()
    moved = in_a & in_b & ~(F.col("page_a").eqNullSafe(F.col("page_b")) & F.col("box_a").eqNullSafe(F.col("box_b")))
    return both.groupBy("document_token").agg(F.count_if(in_a & in_b & ~moved).alias("aligned"), F.count_if(moved).alias("moved"), F.count_if(in_a & ~in_b).alias("left_only"), F.count_if(in_b & ~in_a).alias("right_only"))


def bands(lines: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """``document_token, page_number, band_no, line_index, left``: lines of a page whose heights overlap, merged.

    Intervals in order of their tops: one that begins beyond the furthest bottom so far plus the tolerance begins a
    band. Lines without a box are in none.
    """
    seen = reading_order(lines).withColumns(extents(F.col("bbox"))).filter("top is not null")
    order = Window.partitionBy("document_token", "page_number").orderBy("top", "bottom", "line_index")
    reached = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = seen.withColumn("begins", F.when(reached.isNull() | (F.col("top") > reached + tolerance), 1).otherwise(0))
    return begun.select("document_token", "page_number", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int").alias("band_no"), "line_index", "left")


def band_texts(lines: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """``document_token, page_number, band_no, lines, text``: each band's lines in order of their left edges."""
    rows = bands(lines, tolerance).join(reading_order(lines).select("document_token", "line_index", "text"), ["document_token", "line_index"])
    ordered = F.array_sort(F.collect_list(F.struct("left", "line_index", "text")))
    return rows.groupBy("document_token", "page_number", "band_no").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def table_rows(lines: DataFrame, reach: int = 6) -> DataFrame:
    """Measurements of lines one below the other: a name, then within ``reach`` lines a value, a unit and a range.

    ``document_token, line_index, name, value, unit, low, high, missing``. A name is a line of letters with a number
    line in reach; the first one is its value, whatever stands between (foot and head lines of a page among it), and
    the unit and range are the first of their kind after it in reach. Rows are drafts: any line of letters above a
    value may name it. ``missing`` names what was not found. The rows within reach are read by leads over the
    document, one sort and no self-join.
    """
    order = Window.partitionBy("document_token").orderBy("line_index")
    text = F.trim("text")
    ahead = F.array(*[F.lead("text", k).over(order) for k in range(1, reach + 1)])
    seen = reading_order(lines).withColumn("ahead", F.transform(ahead, lambda t: F.trim(t)))
    letters = text.rlike(r"^(?=.*\p{L})[\p{L}\p{N} .,()/-]{2,40}$") & ~text.rlike(NUMBER_LINE) & ~text.rlike(RANGE_LINE) & ~text.rlike(UNIT_LINE)
    at = F.array_position(F.transform("ahead", lambda t: F.coalesce(t.rlike(NUMBER_LINE), F.lit(False))), True).cast("int")
    rows = seen.filter(letters).withColumn("at", at).filter("at > 0")
    number = F.replace(F.element_at("ahead", F.col("at")), F.lit(","), F.lit("."))
    near = F.slice("ahead", F.col("at") + 1, F.lit(reach))
    unit = F.try_element_at(F.filter(near, lambda t: t.rlike(UNIT_LINE)), F.lit(1))
    span = F.try_element_at(F.filter(near, lambda t: t.rlike(RANGE_LINE)), F.lit(1))
    out = rows.select("document_token", "line_index", text.alias("name"), finite_number(F.regexp_replace(number, "[<>≤≥]", "")).alias("value"), unit.alias("unit"), F.replace(F.split_part(span, F.lit("-"), F.lit(1)), F.lit(","), F.lit(".")).try_cast("double").alias("low"), F.replace(F.split_part(span, F.lit("-"), F.lit(2)), F.lit(","), F.lit(".")).try_cast("double").alias("high"))
    return out.withColumn("missing", F.array_join(F.array_compact(F.array(F.when(F.col("unit").isNull(), "unit"), F.when(F.col("low").isNull(), "range"))), ","))


# Names of one measurement and its short form, roles of times, numbers, ranges and units within a line.
TARGET_NAME = r"(?i)^[\s*#·※]*(?:血红蛋白(?:量|浓度)?|ha?emoglobin)(?:[\s*#·]*[（(]\s*(?:HGB|Hb)\s*[)）])?[\s*#·]*$"
TARGET_ALIAS = r"(?i)(?<![A-Za-z])HGB(?![A-Za-z])"
ROLE_CUES = {"collection": r"(?i)采集时间|采样时间|采血时间|collection\s*time|collected", "report": r"(?i)报告时间|报告日期|report\s*time|reported"}
INLINE_RANGE = r"[-+]?\d+(?:[.,]\d+)?\s*(?:--|[-~～至])\s*[-+]?\d+(?:[.,]\d+)?"
INLINE_UNIT = r"(?i)(?:g\s*/\s*dL|g\s*/\s*L|mg\s*/\s*dL|mg\s*/\s*L|mmol\s*/\s*L|10\s*\^?\s*9\s*/\s*L|%)"


def measurements(lines: DataFrame, *, name: str = TARGET_NAME, alias: str = TARGET_ALIAS, roles: Mapping[str, str] = ROLE_CUES, moment: Callable[[Column], tuple[Column, Column]] = moment_of, reach: int = 6) -> DataFrame:
    """One measurement wherever a page names it: value, unit and range in the lines after the name, and both times.

    A start is a line that is the name as a whole, or one that holds the short form unless the line before is the name;
    without a full name it is an ``invalid_task``. Of the ``reach`` lines of the page after it, blank ones and those of
    a time's role are passed over; the first with a number that is no range holds the value, the first after it with
    a unit the unit (if the value's line has none), and the next with a range the range, which ends the search. Each
    role's time is that of the nearest line at or after the start, else before it, that tells one. Both come from
    windows over the page, with no join. Columns: ``record_id, identity_status, binding_status, document_token,
    page_number, line_index, project_name, project_ref, result_ref, value, unit, unit_ref, reference_interval,
    reference_ref, {role}_ref, {role}_time, {role}_precision, value_g_l, source_refs``.
    """
    text = F.trim("text")
    page = Window.partitionBy("document_token", "page_number").orderBy("line_index")
    role_line = F.lit(False)
    for cue in roles.values():
        role_line = role_line | text.rlike(cue)
    seen = reading_order(lines).select("document_token", "page_number", "line_index", text.alias("text"), role_line.alias("of_role"), text.rlike(name).alias("named"), text.rlike(alias).alias("short"))
    value, unit = first_number(F.col("text")), F.nullif(F.regexp_extract("text", f"({INLINE_UNIT})", 1), F.lit(""))
    usable = (F.col("text") != "") & ~F.col("of_role")
    seen = seen.withColumn("cell", F.struct(F.col("line_index").alias("ref"), F.when(usable, value).alias("value"), F.when(usable, unit).alias("unit"), F.when(usable & F.col("text").rlike(INLINE_RANGE), F.col("text")).alias("span")))
    # The marks of each role, filled from both sides.
    after, before = page.rowsBetween(Window.currentRow, Window.unboundedFollowing), page.rowsBetween(Window.unboundedPreceding, -1)
    for role, cue in roles.items():
        at, precision = moment(F.col("text"))
        mark = F.when(F.col("text").rlike(cue) & at.isNotNull(), F.struct(F.col("line_index").alias("ref"), at.alias("time"), precision.alias("precision")))
        seen = seen.withColumn("mark", mark).withColumn(role, F.coalesce(F.first("mark", ignorenulls=True).over(after), F.last("mark", ignorenulls=True).over(before))).drop("mark")
    ahead = F.array_compact(F.array(*[F.lead("cell", k).over(page) for k in range(1, reach + 1)]))
    begun = seen.withColumns({"ahead": ahead, "follows": F.coalesce(F.lag("named").over(page), F.lit(False))}).filter("named or short and not follows")
    at = F.array_position(F.transform("ahead", lambda c: c["value"].isNotNull()), True).cast("int")
    begun = begun.withColumn("at", at).withColumns({"result": F.when(F.col("at") > 0, F.try_element_at("ahead", F.col("at"))), "rest": F.when(F.col("at") > 0, F.slice("ahead", F.col("at") + 1, F.lit(reach))).otherwise(F.slice("ahead", 1, 0))})
    first = lambda rows, keep: F.try_element_at(F.filter(rows, keep), F.lit(1))
    begun = begun.withColumns({"unit_row": first("rest", lambda c: c["unit"].isNotNull()), "bare_span": first("rest", lambda c: c["span"].isNotNull() & c["unit"].isNull()), "any_span": first("rest", lambda c: c["span"].isNotNull())})
    # A range before any unit ends the search; behind a unit the next range counts.
    inline = F.col("result.unit").isNotNull()
    ended = ~inline & F.col("bare_span").isNotNull() & (F.col("unit_row").isNull() | (F.col("bare_span.ref") < F.col("unit_row.ref")))
    begun = begun.withColumn("unit_row", F.when(~inline & ~ended, F.col("unit_row")))
    behind = first("rest", lambda c: c["span"].isNotNull() & (c["ref"] > F.col("unit_row.ref")))
    begun = begun.withColumn("range_row", F.when(inline, F.col("any_span")).when(ended, F.col("bare_span")).when(F.col("unit_row").isNotNull(), behind))
    shown = F.coalesce("result.unit", "unit_row.unit")
    known = {"g/dl": "g/dL", "g/l": "g/L", "mg/dl": "mg/dL", "mg/l": "mg/L"}
    plain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), unit_key(shown)), shown)
    out = begun.select(
        "document_token", "page_number", "line_index", F.when(F.col("named"), F.col("text")).alias("project_name"), F.when(F.col("named"), F.col("line_index")).alias("project_ref"), F.col("result.ref").alias("result_ref"), F.col("result.value").alias("value"),
        plain.alias("unit"), F.when(inline, F.col("result.ref")).otherwise(F.col("unit_row.ref")).alias("unit_ref"), F.col("range_row.span").alias("reference_interval"), F.col("range_row.ref").alias("reference_ref"), *[F.col(f"{r}.{c}").alias(f"{r}_{c}") for r in roles for c in ("ref", "time", "precision")],
    )
    refs = ("project_ref", "result_ref", "unit_ref", "reference_ref", *[f"{r}_ref" for r in roles])
    explicit = F.col("project_ref").isNotNull()
    bound = explicit & F.col("result_ref").isNotNull() & (F.col("collection_ref").isNotNull() if "collection" in roles else F.lit(True))
    return out.withColumns({
        "record_id": F.when(explicit, row_id(F.col("document_token"), F.col("page_number"), F.col("project_ref"), F.coalesce(F.col("result_ref").cast("string"), F.lit("None")))), "identity_status": F.when(explicit, "explicit").otherwise("invalid_task"),
        "binding_status": F.when(bound, "explicit").otherwise("unresolved"), "value_g_l": grams_per_litre(F.col("value"), F.col("unit")), "source_refs": F.array_compact(F.array(*refs)),
    })


def header_in_scope(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The nearest header at or above each row on its page, a backward as-of join with tie detection.

    ``rows`` has ``document_token, page_number, row_id, top``; ``headers`` the same with ``header_id``. Two headers at
    the nearest height leave the row unresolved. Both sides go through one window, ordered by height, headers first;
    no pair is formed.
    """
    h = headers.select("document_token", "page_number", "top", F.lit(0).alias("side"), F.lit(None).cast("string").alias("row_id"), F.col("header_id").cast("string").alias("header_id"))
    h = h.groupBy("document_token", "page_number", "top", "side", "row_id").agg(F.min("header_id").alias("header_id"), F.count(F.lit(1)).alias("at_height"))
    r = rows.select("document_token", "page_number", "top", F.lit(1).alias("side"), F.col("row_id").cast("string").alias("row_id"), F.lit(None).cast("string").alias("header_id"), F.lit(None).cast("long").alias("at_height"))
    order = Window.partitionBy("document_token", "page_number").orderBy("top", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("side") == 0, F.struct("header_id", "at_height", "top")), ignorenulls=True).over(order)
    seen = h.unionByName(r).withColumn("scope", last).filter("side = 1")
    return seen.select("document_token", "page_number", "row_id", F.when(F.col("scope.at_height") == 1, F.col("scope.header_id")).alias("header_id"), F.when(F.col("scope").isNull(), "none").when(F.col("scope.at_height") > 1, "tie").otherwise("explicit").alias("binding"))


def nearest_marked(lines: DataFrame, k: int = 2) -> DataFrame:
    """For each number line the ``k`` lines of its page nearest in height that name a relative day, in order of height.

    ``document_token, line_index, days``. Marked lines per page are few and grouped first; numbers meet their page's
    list, not each line of it.
    """
    seen = reading_order(lines).withColumns(extents(F.col("bbox"))).withColumn("day", day_marker(F.col("text")))
    marks = seen.filter("day is not null and top is not null").groupBy("document_token", "page_number").agg(F.array_sort(F.collect_list(F.struct("top", "day"))).alias("marks"))
    rows = seen.filter(F.trim("text").rlike(NUMBER_LINE) & F.col("top").isNotNull()).join(marks, ["document_token", "page_number"], "left")
    near = F.slice(F.array_sort(F.transform("marks", lambda m: F.struct(F.abs(m["top"] - F.col("top")).alias("far"), m["top"].alias("top"), m["day"].alias("day")))), 1, k)
    days = F.transform(F.array_sort(F.transform(near, lambda m: F.struct(m["top"].alias("top"), m["day"].alias("day")))), lambda m: m["day"])
    return rows.select("document_token", "line_index", F.coalesce(days, F.array().cast("array<int>")).alias("days"))


def preferred_role(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """For each row the nearest mark of its document, one after it before any before it; the first of equal ones.

    ``rows``: ``document_token, row_index``; ``marks``: ``document_token, mark_index``. Two ordered fills over one
    window instead of a join of all pairs.
    """
    u = rows.select("document_token", F.col("row_index").alias("i"), F.lit(1).alias("is_row")).unionByName(marks.select("document_token", F.col("mark_index").alias("i"), F.lit(0).alias("is_row")).distinct())
    mark = F.when(F.col("is_row") == 0, F.col("i"))
    up = Window.partitionBy("document_token").orderBy("i", "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("document_token").orderBy(F.col("i").desc(), "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = u.withColumns({"before": F.last(mark, ignorenulls=True).over(up), "after": F.last(mark, ignorenulls=True).over(down)})
    return seen.filter("is_row = 1").select("document_token", F.col("i").alias("row_index"), F.coalesce("after", "before").alias("mark_index"))


def line_cells(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, value_text, value_numeric, unit, issues`` of lines that hold a number.

    Below a bound there is a text, no number. The value is the last number before the unit, else the line's last.
    """
    seen = reading_order(lines)
    unit = F.nullif(F.regexp_extract("text", f"({UNIT_PATTERN})", 1), F.lit(""))
    value = last_number_before(F.col("text"), UNIT_PATTERN)
    out = seen.select("document_token", "line_index", value.alias("value_text"), unit.alias("unit")).filter("value_text is not null")
    issues = F.array_compact(F.array(F.when(F.col("value_text").rlike("^[<>]"), "bounded"), F.when(F.col("unit").isNull(), "no_unit")))
    return out.select("document_token", "line_index", "value_text", F.when(~F.col("value_text").rlike("^[<>]"), finite_number(F.col("value_text"))).alias("value_numeric"), "unit", F.array_join(issues, ",").alias("issues"))


def page_rules(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, rules``: the rules reported for the line's page, each once, in order."""
    seen = reading_order(lines, ("redaction_rules", "residual_rules"))
    both = F.concat(F.coalesce("redaction_rules", F.array().cast("array<string>")), F.coalesce("residual_rules", F.array().cast("array<string>")))
    rules = seen.select("document_token", "page_number", F.explode(both).alias("rule")).distinct().groupBy("document_token", "page_number").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))
    return seen.select("document_token", "page_number", "line_index").join(rules, ["document_token", "page_number"], "left").select("document_token", "line_index", F.coalesce("rules", F.lit("")).alias("rules"))


def rule_histogram(lines: DataFrame) -> DataFrame:
    """How many pages report each rule, by list."""
    seen = reading_order(lines, ("redaction_rules", "residual_rules"))
    one = lambda c: seen.select("document_token", "page_number", F.lit(c).alias("list"), F.explode(c).alias("rule")).distinct()
    return one("redaction_rules").unionByName(one("residual_rules")).groupBy("list", "rule").agg(F.count(F.lit(1)).alias("pages"))


def day_candidates(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, ordinal, day``: every relative day a line names, in order; several in one line apart."""
    found = F.regexp_extract_all("text", F.lit(r"(?:\b[Dd]ay |\bTag |第)(\d{1,4})"), 1)
    return reading_order(lines).select("document_token", "line_index", F.posexplode(found).alias("ordinal", "d")).select("document_token", "line_index", "ordinal", F.col("d").cast("int").alias("day"))


def case_coordinates(lines: DataFrame) -> DataFrame:
    """Per case the day origin over its documents and a stable coordinate id.

    ``case_token, origin_day, reference_document, documents, candidates, coordinate_id``: the origin is the least
    day named; its document is the first by day, then document, line and ordinal.
    """
    cases = lines.select("document_token", "case_token").filter("case_token is not null").groupBy("document_token").agg(F.min("case_token").alias("case_token"))
    days = day_candidates(lines).join(cases, "document_token")
    per = days.groupBy("case_token").agg(F.min(F.struct("day", "document_token", "line_index", "ordinal")).alias("o"), F.count_distinct("document_token").alias("documents"), F.count(F.lit(1)).alias("candidates"))
    ident = F.concat(F.lit("day0-"), F.substring(F.sha2(F.concat_ws("|", "case_token", F.col("o.document_token"), F.col("o.day").cast("string")), 256), 1, 12))
    return per.select("case_token", F.col("o.day").alias("origin_day"), F.col("o.document_token").alias("reference_document"), "documents", "candidates", ident.alias("coordinate_id"))
