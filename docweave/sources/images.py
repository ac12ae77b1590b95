"""Images: headers, the size that an image is shown in, pixels turned upright and made smaller."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.store import exists, shared_folder, stored, write_files

LONG_EDGE = 2000
#: A mark of images that are too large or not upright.
UNFITTED = "unfitted"


def size(content: bytes) -> tuple[int, int, int]:
    """Width, height, EXIF orientation (1 if there is none) of a PNG or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return *struct.unpack(">II", content[16:24]), 1
    if content[:2] != b"\xff\xd8":
        raise ValueError("neither PNG nor JPEG")
    at, turn = 2, 1
    while at + 4 <= len(content):
        mark, n = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if mark == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            turn = _orientation(content[at + 10 : at + 2 + n])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return width, height, turn
        at += 2 + n
    raise ValueError("no frame in the JPEG")


def _orientation(tiff: bytes) -> int:
    end = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(end + "I", tiff[4:8])[0]
    for k in range(struct.unpack(end + "H", tiff[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(end + "HHIH", tiff[at + 2 + 12 * k : at + 12 + 12 * k])
        if tag == 0x112:
            return value
    return 1


def fitted(width: int, height: int, turn: int = 1, edge: int = LONG_EDGE) -> tuple[int, int]:
    """The size within the long edge, upright, never enlarged."""
    if turn >= 5:
        width, height = height, width
    scale = min(1.0, edge / max(width, height))
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def png_pixels(content: bytes):
    """The pixels (height, width, channels) of a PNG of 8 bits a channel without interlacing; None for others."""
    import numpy as np

    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or channels is None:
        return None
    at, data = 8, []
    while at + 8 <= len(content):
        n, mark = struct.unpack(">I", content[at : at + 4])[0], content[at + 4 : at + 8]
        if mark == b"IDAT":
            data.append(content[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, channels)
    return out.reshape(height, width, channels)


def _unfiltered(kind: int, line, above, step: int):
    """A line of a PNG without its filter."""
    import numpy as np

    if kind in (0, 2):
        return line + above if kind else line
    out = np.zeros(len(line) + step, np.int64)
    up, corner = above.astype(np.int64), np.r_[np.zeros(step, np.int64), above[:-step].astype(np.int64)]
    for k in range(len(line)):
        left = out[k]
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[k]) // 2
        else:
            near = left + up[k] - corner[k]
            guess = min((abs(near - left), 0, left), (abs(near - up[k]), 1, up[k]), (abs(near - corner[k]), 2, corner[k]))[2]
        out[k + step] = (line[k] + guess) & 255
    return out[step:].astype(np.uint8)


def turned(pixels, turn: int):
    """Upright, by the EXIF orientation."""
    import numpy as np

    if turn >= 5:
        pixels = pixels.transpose(1, 0, 2)
    if turn in (3, 4, 7, 8):
        pixels = np.flip(pixels, 0)
    if turn in (2, 3, 6, 7):
        pixels = np.flip(pixels, 1)
    return pixels


def shrunk(pixels, edge: int = LONG_EDGE):
    """Within the long edge, as means over areas; never enlarged."""
    import numpy as np

    height, width = pixels.shape[:2]
    new_width, new_height = fitted(width, height, 1, edge)
    for axis, (old, new) in enumerate(((height, new_height), (width, new_width))):
        if new < old:
            cuts = np.arange(new) * old // new
            total = np.add.reduceat(pixels.astype(np.float64), cuts, axis=axis)
            pixels = total / np.diff(np.r_[cuts, old]).reshape([-1 if k == axis else 1 for k in range(3)])
    return np.floor(pixels + 0.5).astype(np.uint8)


def kind_of(content: bytes) -> str:
    """By its first bytes; what is not known counts as PNG."""
    heads = {b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif", b"BM": "image/bmp", b"II*\0": "image/tiff", b"MM\0*": "image/tiff"}
    return next((kind for head, kind in heads.items() if content.startswith(head)), "image/webp" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else "image/png")


def prepared(content: bytes, edge: int = LONG_EDGE) -> tuple[bytes, str]:
    """An image as it is sent: a PNG within the long edge, its kind beside it. What cannot be decoded here (JPEG, rare PNGs) stays as it is; see unfitted() and upright()."""
    from docweave.sources.writers import png

    width, height, turn = size(content)
    mime = "image/png" if content[:4] == b"\x89PNG" else "image/jpeg"
    if max(width, height) <= edge and turn == 1:
        return content, mime
    pixels = png_pixels(content)
    if pixels is None or pixels.shape[2] == 2:
        return content, mime
    pixels = shrunk(turned(pixels, turn), edge)
    return png(pixels.shape[1], pixels.shape[0], pixels.tobytes(), pixels.shape[2]), "image/png"


def unfitted(content: bytes, edge: int = LONG_EDGE) -> bool:
    """Whether an image is too large or not upright; False for what has no size that can be read."""
    try:
        width, height, turn = size(content)
    except (ValueError, IndexError, struct.error):
        return False
    return max(width, height) > edge or turn != 1


def upright(parts: DataFrame, edge: int = LONG_EDGE) -> DataFrame:
    """parts (image, mime, value_type and others) where images marked as unfitted are upright PNGs within the long edge, as far as Spark can decode them; others stay.

    Spark decodes files, so the images, each content once, are written into the shared folder and read from there
    by its image source, in the tasks that have them; a part finds its image again by the hash of what it was.
    """
    marked = F.col("value_type") == UNFITTED
    todo = parts.where(marked).select(F.sha2("image", 256).alias("key"), "image").dropDuplicates(["key"])
    if todo.isEmpty():
        return parts
    spark = parts.sparkSession
    folder = shared_folder(spark)
    write_files(todo.select(F.concat(F.lit(f"{folder}/"), "key").alias("path"), F.col("image").alias("content"))).write.format("noop").mode("overwrite").save()
    fit = decoded(spark, folder, edge=edge).select(F.regexp_extract("path", "([^/]*)$", 1).alias("__key"), F.col("image").alias("__png"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("__size"))
    fit = stored(fit)
    names, there = parts.columns, F.col("__png").isNotNull()
    new = {"image": F.coalesce("__png", "image"), "mime": F.when(there, F.lit("image/png")).otherwise(F.col("mime")), "ref": F.when(there & F.col("ref").isNotNull(), F.col("__size")).otherwise(F.col("ref")), "value_type": F.when(~marked | F.col("value_type").isNull(), F.col("value_type"))}
    return parts.withColumn("__key", F.when(marked, F.sha2("image", 256))).join(fit, "__key", "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in names))


#: Images that Spark's image source is given at once: the driver lists them.
ROUND = 50_000
DECODED = "path string, width int, height int, image binary"


def decoded(spark: SparkSession, *paths: str, edge: int = LONG_EDGE) -> DataFrame:
    """path, width, height, image of PNG and JPEG files, upright and within the long edge, as PNG. Usual PNGs are decoded by the tasks that read them; all others by Spark's image source, in rounds, since its driver lists the files of each."""
    from docweave.sources.scan import binary_files

    def run(batches):
        import pyarrow as pa

        from docweave.sources.writers import png

        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                path, content = batch.column("path")[k].as_py(), batch.column("content")[k].as_py()
                try:
                    pixels = png_pixels(content)
                except Exception:  # Spark's source says whether it is an image
                    pixels = None
                if pixels is None or pixels.shape[2] == 2:
                    out.append((path, None, None, None, content))
                else:
                    pixels = shrunk(pixels, edge)
                    out.append((path, pixels.shape[1], pixels.shape[0], png(pixels.shape[1], pixels.shape[0], pixels.tobytes(), pixels.shape[2]), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["path", "width", "height", "image", "content"])

    found = stored(binary_files(spark, *paths).select("path", "content").mapInArrow(run, f"{DECODED}, content binary"))
    own, other = found.where("content is null").drop("content"), found.where("content is not null").select("path", "content", F.sha2("path", 256).alias("key"))
    count = other.count()
    if not count:
        return own
    folder, out, rounds = shared_folder(spark), shared_folder(spark), -(-count // ROUND)
    place = F.concat(F.lit(f"{folder}/"), F.pmod(F.xxhash64("key"), F.lit(rounds)).cast("string"), F.lit("/"), "key")
    write_files(other.select(place.alias("path"), "content")).write.format("noop").mode("overwrite").save()
    for k in range(rounds):
        if exists(spark, f"{folder}/{k}"):
            _by_spark(spark, f"{folder}/{k}", edge=edge).write.mode("append").parquet(out)
    fit = spark.read.schema(DECODED).parquet(out).withColumn("key", F.regexp_extract("path", "([^/]*)$", 1)).drop("path")
    return own.unionByName(other.select("path", "key").join(fit, "key").drop("key"))


def _by_spark(spark: SparkSession, *paths: str, edge: int) -> DataFrame:
    """DECODED of files by Spark's image source; the orientation comes from the file's head."""
    found = spark.read.format("image").option("dropInvalid", True).load(list(paths)).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    heads = spark.read.format("binaryFile").load(list(paths)).select("path", F.substring("content", 1, 1 << 16).alias("head"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from docweave.sources.writers import png

        for batch in batches:
            out: list[tuple] = []
            for path, height, width, channels, data, head in zip(*(batch.column(c).to_pylist() for c in ("path", "height", "width", "nChannels", "data", "head")), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., [2, 1, 0, 3][:channels] if channels > 1 else [0]]
                try:
                    turn = size(head)[2]
                except ValueError:
                    turn = 1
                pixels = shrunk(turned(pixels, turn), edge)
                out.append((path, pixels.shape[1], pixels.shape[0], png(pixels.shape[1], pixels.shape[0], pixels.tobytes(), channels)))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["path", "width", "height", "image"])

    return found.join(heads.withColumnRenamed("path", "head_path"), F.regexp_replace("path", "^file:/+", "/") == F.regexp_replace("head_path", "^file:/+", "/")).drop("head_path").mapInArrow(run, "path string, width int, height int, image binary")
