"""Result envelopes, sinks and the request modes as callable plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import arrays as A, media as M, pagerow as R
from ..profiles import (
    AUTO_EXCLUDE,
    AUTO_LIMIT,
    AUTO_SUB_SELECTORS,
    PROFILES,
    SUGGESTED_EXCLUDES,
    SUGGESTED_SELECTORS,
    ArraySpec,
    SelectiveSpec,
    profile_length,
)
from ..sources import pages as P
from . import content as C, selective as S

FORMATS = ("parquet", "json")


def error_json(error: Column, details: Column | None = None) -> Column:
    """A10: ``{success: false, error, details?}``; details only when there are some."""
    fields = [F.lit(False).alias("success"), error.alias("error")]
    if details is not None:
        fields.append(details.alias("details"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def success_envelope(df: DataFrame, payload: str, message: str = "Success") -> DataFrame:
    """A struct payload is merged into the envelope, another one goes
    under ``data``. Columns other than the payload are kept in front."""
    rest = [c for c in df.columns if c != payload]
    merged = f"{payload}.*" if df.schema[payload].dataType.typeName() == "struct" else F.col(payload).alias("data")
    return df.select(*rest, F.lit(True).alias("success"), F.lit(message).alias("message"), merged)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results as a table partitioned by success, replacing the folder."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    df.write.mode("overwrite").partitionBy("success").format(fmt).save(path)


METADATA = {
    "basic": ("content_length",),
    "content": ("original_html_length", "content_length", "extraction_mode"),
    "selective": ("original_html_length", "extraction_method", "selectors_used", "total_sections",
                  "deduplication_applied", "selectors_provided", "content_analysis"),
    "array": ("original_html_length", "extraction_mode", "array_selectors_used", "exclude_selectors_used", "format_output",
              "arrays", "content_quality", "total_selectors", "total_items_extracted", "successful_selectors"),
}


def result_metadata(mode: str, df: DataFrame) -> Column:
    """The metadata struct of a mode (basic, content, selective, array), from its result columns. In the
    selective mode ``selectors_used`` holds section keys, not selectors."""
    return F.struct(*[F.col(c) for c in METADATA[mode] if c in df.columns])


def with_media(results: DataFrame, pages: DataFrame, skip_images: bool = False, skip_links: bool = False) -> DataFrame:
    """Images and links joined to the results by page."""
    return results.join(M.media_columns(pages, skip_images, skip_links), "page_id", "left")


def auto_fields(pages: DataFrame, main_selector: str, partitions: int | None = None) -> DataFrame:
    """the simple array mode: preset sub-selectors, excludes and limit; the
    first value of a field, and a matched ``content`` before the main text."""
    spec = ArraySpec("items", main_selector, AUTO_SUB_SELECTORS, AUTO_LIMIT)
    items = A.absolutize(A.array_items(pages, [spec], exclude=AUTO_EXCLUDE, partitions=partitions), [spec])
    value = {n: F.coalesce(F.try_element_at(F.col("fields")[n], F.lit(1)), F.lit("")) for n, _ in AUTO_SUB_SELECTORS}
    value["content"] = F.when(value["content"] != "", value["content"]).otherwise(F.col("main_content"))
    return items.select("page_id", "index", *[v.alias(n) for n, v in value.items()], "word_count")


# --- array results ------------------------------------------------------------------

OUTPUTS = {"structured": A.format_structured, "flat": A.format_flat, "summary": A.format_summary}


def array_results(pages: DataFrame, specs: list[ArraySpec], exclude=(), output: str = "structured") -> DataFrame:
    """F17 as a result row per page (F13 to F16): title, the formatted content, the words of all items and the array mode's
    metadata. Failed fetches and pages without html are failures (A3)."""
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")
    specs = A.check_specs(specs)
    rows = A.absolutize_pages(A.array_pages(C.fetched(pages), specs, exclude, keep_title=True), specs)
    ok = F.col("ok") & F.col("failure").isNull()
    rows = rows.withColumn("_s", A.page_summary())
    return rows.select(
        "page_id", "url", ok.alias("success"),
        F.coalesce("error", F.when(F.col("failure").isNotNull(), F.concat(F.lit("Array processing failed: "), F.col("failure")))).alias("error"),
        F.when(ok, R.title_text()).otherwise(F.lit("")).alias("title"),
        F.when(ok, OUTPUTS[output]()).otherwise(F.lit("")).alias("content"),
        F.when(ok, F.col("_s.total_words")).otherwise(F.lit(0)).alias("word_count"),
        "original_html_length", F.lit("array_based_ordered").alias("extraction_mode"),
        F.array(*[F.lit(s.name) for s in specs]).cast("array<string>").alias("array_selectors_used"),
        F.array(*[F.lit(x) for x in exclude]).cast("array<string>").alias("exclude_selectors_used"),
        F.lit(output).alias("format_output"),
        "arrays", F.struct(F.col("_s.total_items_extracted").alias("total_items"), F.lit(True).alias("order_preserved"),
                           F.lit(True).alias("image_urls_absolute"), F.lit(True).alias("link_urls_absolute")).alias("content_quality"),
        "_s.total_selectors", "_s.total_items_extracted", "_s.successful_selectors")


def batch_items(results: DataFrame) -> DataFrame:
    """F18 per URL: success, error, total_found and the items of the first array, every sub-field flat: the first of its
    values, or empty."""
    items = F.transform(F.get(F.col("arrays"), F.lit(0))["items"], lambda x: F.struct(
        x["index"].alias("index"), x["main_content"].alias("main_content"), x["word_count"].alias("word_count"),
        F.transform_values(x["fields"], lambda k, v: A.flatten_field(v, "first")).alias("fields")))
    ok = F.col("success")
    return results.select("page_id", "url", "success", F.when(~ok, F.coalesce("error", F.lit("Extraction failed"))).alias("error"),
                          F.when(ok, F.size(items)).otherwise(F.lit(0)).alias("total_found"), F.when(ok, items).alias("items"))


def batch_totals(rows: DataFrame) -> DataFrame:
    """F18 over all URLs: processed, successful, failed, items."""
    return rows.agg(F.count(F.lit(1)).alias("total_urls_processed"), F.count_if("success").alias("successful_extractions"),
                    F.count_if(~F.col("success")).alias("failed_extractions"),
                    F.coalesce(F.sum("total_found"), F.lit(0)).alias("total_items_found"))


def analyze(pages: DataFrame, max_suggestions: int | None = None) -> DataFrame:
    """The structure analysis of each page: a preview of its default selective content and the suggested selectors."""
    limits = PROFILES["analyze"]
    n = min(max_suggestions or limits["suggestions"], limits["suggestions_cap"])
    r = S.selective(pages, SelectiveSpec(max_length=limits["max_length"]))
    struct = lambda names, values: F.struct(*[F.lit(v).alias(k) for k, v in zip(names, values, strict=True)])
    return r.select(
        "page_id", "url", "success", "error", "title", X.preview("content").alias("content_preview"), "word_count",
        F.array(*[struct(("selector", "description", "priority"), x) for x in SUGGESTED_SELECTORS[:n]]).alias("suggested_selectors"),
        F.array(*[struct(("selector", "description"), x) for x in SUGGESTED_EXCLUDES]).alias("exclude_suggestions"))


# --- request modes ------------------------------------------------------------------

def run_mode(pages: DataFrame, mode: str, max_length: int | None = None, spec: SelectiveSpec | None = None,
             arrays: list[ArraySpec] | None = None, exclude=(), output: str = "structured") -> DataFrame:
    """One plan per request mode with its limits: lengths and item limits are capped; selector, exclude
    and array counts over the mode's limit raise."""
    limits = PROFILES[mode]
    if mode.startswith("crawl"):
        return C.basic_content(pages, profile_length(mode, max_length))
    if mode.startswith("content"):
        return C.content_only(pages, profile_length(mode, max_length))
    if mode.startswith("selective"):
        spec = (spec or SelectiveSpec()).validate(limits["selectors"], limits["excludes"])
        return S.selective(pages, SelectiveSpec(spec.selectors, spec.exclude, profile_length(mode, spec.max_length),
                                                spec.return_sections))
    if mode == "analyze":
        return analyze(pages, limits["suggestions"])
    if not arrays:
        raise ValueError("'selector' field is required")
    if mode == "array_simple":
        return auto_fields(pages, arrays[0].selector)
    capped = [ArraySpec(a.name, a.selector, a.sub_selectors, min(a.limit or limits["limit"], limits["limit_cap"])) for a in arrays]
    out = array_results(pages, capped, exclude, output)
    return batch_items(out) if mode == "array_batch" else out


def run_batch(requests: DataFrame, pages: DataFrame, mode: str, **options) -> DataFrame:
    """Batch requests (batch_id, urls) in a batch mode: a batch that A6 rejects, the mode's cap included, is one error
    row; every URL of the others is one row in input order (A2), with the mode's result as a struct."""
    checked = P.validate_batches(requests, max_batch_size=PROFILES[mode]["batch"])
    bad = checked.where("error is not null").select("batch_id", F.lit(-1).alias("batch_pos"), F.lit(None).cast("string").alias("url"),
                                                    F.lit(False).alias("found"), "error")
    found = P.lookup_urls(P.requests_from(checked.where("error is null"), "batch_id", "kept_urls"), pages)
    wanted = pages.join(found.where("found").select("page_id").distinct(), "page_id", "left_semi")
    result = run_mode(wanted, mode, **options)
    result = result.select(F.col("url").alias("_u"), F.struct(*result.columns).alias("result")).dropDuplicates(["_u"])
    rows = found.join(result, F.col("url") == F.col("_u"), "left").drop("_u", "page_id")
    return rows.unionByName(bad, allowMissingColumns=True)
