"""Seals and signatures with all their fields. Ids tell the page, so they do not repeat within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONFIDENCE = 0.7
#: Of PDF pages, images (always page 1) and images in DOCX files: what an id begins with and the kind of locator.
PDF, IMAGE = ("p", "pdf-bbox"), ("", "image-bbox")


def normalise_seals(seals: Column, page_no: Column, locator: str = PDF[1], prefix: str = PDF[0]) -> Column:
    """seals of functions.text.seal_marks as array<struct(seal_id, type, owner, color, shape, confidence, locator_kind, page_no, section_id)>."""
    return F.transform(
        seals,
        lambda s, i: F.struct(
            F.concat(F.lit(f"seal-{prefix}"), page_no.cast("string"), F.lit("-"), (i + 1).cast("string")).alias("seal_id"), F.lit("unknown").alias("type"), s["owner"].alias("owner"), s["color"].alias("color"),
            s["shape"].alias("shape"), F.lit(CONFIDENCE).alias("confidence"), F.lit(locator).alias("locator_kind"), page_no.cast("int").alias("page_no"), F.lit(None).cast("string").alias("section_id"),
        ),
    )


def normalise_signatures(signatures: Column, page_no: Column, locator: str = PDF[1], prefix: str = PDF[0]) -> Column:
    return F.transform(
        signatures,
        lambda s, i: F.struct(
            F.concat(F.lit(f"sig-{prefix}"), page_no.cast("string"), F.lit("-"), (i + 1).cast("string")).alias("signature_id"), F.lit("handwritten").alias("type"), s["signer"].alias("signer"),
            F.lit(CONFIDENCE).alias("confidence"), F.lit(locator).alias("locator_kind"), page_no.cast("int").alias("page_no"), F.lit(None).cast("string").alias("section_id"),
        ),
    )


def _in_images(images: DataFrame, marks: str, keys: list[str], word: str, id_name: str, kind: str, fields: list[str]) -> DataFrame:
    """The marks of a document's images, numbered through the document."""
    each = images.select(*keys, "image_no", F.posexplode(marks).alias("i", "m"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("image_no", "i"))
    made = F.concat(F.lit(f"{word}-docx-img"), F.col("image_no").cast("string"), F.lit("-"), n.cast("string"))
    section = F.concat(F.lit("embedded-img-"), F.col("image_no").cast("string"))
    return each.select(*keys, made.alias(id_name), F.lit(kind).alias("type"), *(F.col(f"m.{f}").alias(f) for f in fields), F.lit(CONFIDENCE).alias("confidence"), F.lit(IMAGE[1]).alias("locator_kind"), F.lit(None).cast("int").alias("page_no"), section.alias("section_id"))


def seals_in_images(images: DataFrame, keys: list[str]) -> DataFrame:
    """images (keys, image_no, seals) of DOCX files as a row for each seal, numbered through its file, with the fields of normalise_seals."""
    return _in_images(images, "seals", keys, "seal", "seal_id", "unknown", ["owner", "color", "shape"])


def signatures_in_images(images: DataFrame, keys: list[str]) -> DataFrame:
    return _in_images(images, "signatures", keys, "sig", "signature_id", "handwritten", ["signer"])
