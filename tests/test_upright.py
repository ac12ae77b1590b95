"""JPEGs reach a backend upright and within the long edge, wherever they come from."""

import struct

import pytest
from fixtures import docx, zipped

from docweave.config import resolve
from docweave.operators.external import MockOcr
from docweave.plans.engine import DocEngine
from docweave.sources import images
from docweave.sources.scan import binary_files, parse_files


def jpeg(spark, width, height, turn=1):
    """A red left half and a blue right one, with an orientation in its head."""
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(width, height, 1)
    pen = picture.createGraphics()
    pen.setColor(jvm.java.awt.Color.RED)
    pen.fillRect(0, 0, width // 2, height)
    pen.setColor(jvm.java.awt.Color.BLUE)
    pen.fillRect(width // 2, 0, width - width // 2, height)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    data = bytes(out.toByteArray())
    tiff = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x112, 3, 1, turn, 0)
    exif = b"Exif\0\0" + tiff
    return data[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + data[2:] if turn > 1 else data


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("jpegs")
    (d / "fits.jpg").write_bytes(jpeg(spark, 60, 40))
    (d / "large.jpg").write_bytes(jpeg(spark, 300, 120))
    (d / "turned.jpeg").write_bytes(jpeg(spark, 80, 40, 6))
    (d / "broken.jpg").write_bytes(jpeg(spark, 300, 120)[:200])
    (d / "z.zip").write_bytes(zipped({"in.jpg": jpeg(spark, 300, 120), "x.md": "x"}))
    (d / "d.docx").write_bytes(docx(["text"], images=[jpeg(spark, 50, 200)]))
    return d


def shapes(rows):
    return {r["path"].rsplit("/", 1)[1]: (*images.size(r["image"])[:2], r["mime"], r["ref"], r["value_type"]) for r in rows}


def test_upright(spark, folder):
    from docweave.plans.engine import scan_files
    from docweave.sources.scan import ParseOptions

    parts = parse_files(scan_files(spark, str(folder)), ParseOptions(long_edge=100))
    found = shapes(images.upright(parts, 100).where("kind = 'image' and path not like '%broken%'").collect())
    assert found == {
        "fits.jpg": (60, 40, "image/jpeg", "60x40", None), "large.jpg": (100, 40, "image/png", "100x40", None), "turned.jpeg": (40, 80, "image/png", "40x80", None), "z.zip!in.jpg": (100, 40, "image/png", "100x40", None),
    }
    turned = images.png_pixels(images.upright(parts, 100).where("path like '%turned%' and kind = 'image'").first()["image"])
    assert turned[5, 20, 0] > 200 > turned[5, 20, 2] and turned[75, 20, 2] > 200 > turned[75, 20, 0]  # a quarter to the right: left comes up
    assert images.upright(parts, 100).count() == parts.count()
    none = parse_files(binary_files(spark, str(folder / "fits.jpg")))
    assert images.upright(none) is none


def test_what_the_backend_sees(spark, folder):
    class Seeing(MockOcr):
        def recognize(self, image, mime="image/jpeg", detect=False):
            width, height, turn = images.size(bytes(image))
            return {"reply": f"{mime} {width}x{height} {turn}", "prompt_tokens": 0, "completion_tokens": 0}

    engine = DocEngine(spark, resolve({}, image_max_long_edge=100), ocr=Seeing())
    said = {r["path"].rsplit("/", 1)[1]: r["raw"]["full_text"] for r in engine.results([str(folder)], detect=False).where("ok").collect()}
    assert {k: said[k] for k in ("fits.jpg", "large.jpg", "turned.jpeg", "z.zip!in.jpg")} == {"fits.jpg": "image/jpeg 60x40 1", "large.jpg": "image/png 100x40 1", "turned.jpeg": "image/png 40x80 1", "z.zip!in.jpg": "image/png 100x40 1"}
