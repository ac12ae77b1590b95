"""Small files of each format."""

from docweave.sources.doc import doc  # noqa: F401
from docweave.sources.writers import docx, pdf, png, xlsx, zipped  # noqa: F401
from docweave.sources.xls import xls  # noqa: F401
