"""Pictures of manuals: matching descriptions to pictures, normalising them, and merging what was seen in a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import scores as S
from brindle.functions import text as T


def matched(insights: DataFrame, candidates: DataFrame) -> DataFrame:
    """insight_id, asset_id, document_id and strategy: sha256, stem, ambiguous or unmatched.

    insights: insight_id, sha256, file_name, image_id; candidates: asset_id, document_id, sha256, source_name. A digest decides
    where one picture has it, several are ambiguous; else the stems of the file name and image id. Candidates are one row a digest
    or stem before descriptions meet them: its least and largest id tell none, one and several apart.
    """
    first = F.struct("asset_id", "document_id")

    def of_key(key: Column) -> DataFrame:
        rows = candidates.select("asset_id", "document_id", key.alias("key")).where("key <> ''")
        return rows.groupBy("key").agg(F.min("asset_id").alias("lo"), F.max("asset_id").alias("hi"), F.min(first).alias("x"))

    def found(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        several = F.when(F.min("lo").isNull(), 0).when(F.min("lo") == F.max("hi"), 1).otherwise(2)
        return rows.where("key <> ''").join(keys, "key").groupBy("insight_id").agg(several.alias(f"n_{name}"), F.min("x").alias(name))

    digest = F.lower(F.btrim(F.coalesce("sha256", F.lit(""))))
    by_digest = insights.select("insight_id", digest.alias("key"))
    stems = F.explode(F.array_distinct(F.array(T.stem(F.col("file_name")), T.stem(F.col("image_id")))))
    by_stem = insights.select("insight_id", stems.alias("key"))
    out = insights.select("insight_id").join(found(by_digest, of_key(F.lower("sha256")), "a"), "insight_id", "left").join(found(by_stem, of_key(T.stem(F.col("source_name"))), "b"), "insight_id", "left")
    strategy = F.when(F.col("n_a") == 1, "sha256").when(F.col("n_a") > 1, "ambiguous").when(F.col("n_b") == 1, "stem").when(F.col("n_b") > 1, "ambiguous").otherwise("unmatched")
    chosen = F.when(F.col("n_a") == 1, F.col("a")).when(F.col("n_a").isNull() & (F.col("n_b") == 1), F.col("b"))
    return out.select("insight_id", chosen["asset_id"].alias("asset_id"), chosen["document_id"].alias("document_id"), strategy.alias("strategy"))


def normalised(rows: DataFrame, most: int = 12_000) -> DataFrame:
    """Descriptions with their picture's context as rows of an image table; rows with no valid confidence go.

    rows: dataset_id, document_id, asset_id, image_id, file_name, manual_name, chapter_hint, visual_summary, visual_meaning,
    visible_text, search_terms, applicable_questions (arrays), retrieval_text, confidence, page_number.
    """
    text = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    seen, terms, asked = (T.string_list(F.col(c)) for c in ("visible_text", "search_terms", "applicable_questions"))
    caption = F.when(text("visual_summary") != "", text("visual_summary")).otherwise(text("chapter_hint"))
    ocr = F.array_join(seen, "\n")
    parts = F.array(text("manual_name"), text("chapter_hint"), caption, text("visual_meaning"), ocr, F.array_join(terms, "；"), F.array_join(asked, "；"), text("retrieval_text"))
    body = F.substring(F.btrim(F.array_join(F.filter(parts, lambda x: x != ""), "\n")), 1, most)
    name = F.when(text("image_id") != "", text("image_id")).otherwise(F.regexp_replace(F.regexp_extract(F.coalesce("file_name", F.col("asset_id").cast("string")), "[^/]*$", 0), r"(.)\.[^.]+$", "$1"))
    out = rows.withColumn("caption", caption).withColumn("ocr_text", ocr).withColumn("embedding_text", body).withColumn("image_name", name).withColumn("confidence", S.valid_confidence(F.col("confidence"))).where("confidence is not null")
    digest = F.sha2("embedding_text", 256)
    key = F.concat(F.lit("image-"), F.substring(F.sha2(F.concat_ws("|", "dataset_id", "document_id", "asset_id", digest), 256), 1, 24))
    return out.select(key.alias("id"), "dataset_id", "document_id", "asset_id", "image_name", F.greatest(F.lit(1), F.col("page_number").cast("int")).alias("page_number"), "caption", "ocr_text", "embedding_text", F.when(text("retrieval_text") != "", text("retrieval_text")).otherwise(F.col("embedding_text")).alias("retrieval_text"), "confidence", digest.alias("content_hash"))


def fallback_rows(assets: DataFrame, done: DataFrame) -> DataFrame:
    """Pictures without a description that have some text of their own (caption, ocr_text or retrieval_text)."""
    some = F.btrim(F.concat_ws("", "caption", "ocr_text", "retrieval_text")) != ""
    return assets.join(done.select("asset_id").where("asset_id is not null").distinct(), "asset_id", "left_anti").where(some)


def images_of(evidence: DataFrame, images: DataFrame) -> DataFrame:
    """Pictures (asset_id, product, parent_ids) that may stand beside evidence (query_id, parent_id, product)."""
    rows = images.select("asset_id", "product", F.explode("parent_ids").alias("parent_id"))
    return evidence.select("query_id", "parent_id", "product").join(rows, ["parent_id", "product"]).select("query_id", "parent_id", "asset_id").distinct()


_READ = "status string, text string, codes array<string>, labels map<string,string>, confidence double"


def read_output(raw: Column) -> Column:
    """A model's JSON answer about a picture as a struct, with status ok, empty or invalid_response."""
    body = F.from_json(T.json_object(raw), _READ)
    some = (F.btrim(F.coalesce(body["text"], F.lit(""))) != "") | (F.size(F.coalesce(body["codes"], F.array().cast("array<string>"))) > 0)
    status = F.when(F.btrim(F.coalesce(raw, F.lit(""))) == "", "empty").when(T.json_object(raw).isNull() | F.try_parse_json(T.json_object(raw)).isNull(), "invalid_response").when(some, "ok").otherwise("empty")
    return F.struct(status.alias("status"), F.coalesce(body["text"], F.lit("")).alias("text"), T.string_list(body["codes"]).alias("codes"), body["labels"].alias("labels"), F.coalesce(S.valid_confidence(body["confidence"]), F.lit(0.0)).alias("confidence"))


def merged_context(ocr: Column, seen: Column) -> Column:
    """What two readings of a picture say together: text, codes (also labels' values that look like codes), confidence."""
    label_codes = F.filter(F.map_values(F.coalesce(ocr["labels"], F.create_map().cast("map<string,string>"))), lambda v: v.rlike(r"^(?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]{2,40}$"))
    codes = F.array_distinct(F.transform(F.concat(ocr["codes"], label_codes, seen["codes"]), F.upper))
    parts = F.array(*(F.struct(x["status"].alias("status"), x["confidence"].alias("confidence")) for x in (ocr, seen)))
    return F.struct(T.joined_parts([ocr["text"], seen["text"]], 4000).alias("text"), codes.alias("codes"), S.least_confidence(parts).alias("confidence"))


def masked(context: Column, provenance: Column, include_ocr: Column) -> Column:
    """A field of what was seen; null where it was read by OCR and OCR may not reach the answer."""
    return F.when((provenance != "ocr") | include_ocr, context)


def may_cite(kind: Column, multimodal: Column, include_ocr: Column) -> Column:
    """Whether evidence of a kind may be cited: all of it, but of pictures only vision, and OCR where it is allowed."""
    return ~multimodal | (kind == "vision") | ((kind == "ocr") & include_ocr)
