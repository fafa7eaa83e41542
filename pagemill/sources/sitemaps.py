"""M2, M4: sitemap files and the locations they list."""

from __future__ import annotations

import codecs
import gzip
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pagemill.functions.text import col

READ_BYTES = 1 << 20
ROWS = 10_000


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """M4: one row per stored file below ``path``: ``(path, content)``, as it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content")


def _pieces(content: bytes, packed: bool) -> Iterator[str]:
    """The text of a file, a piece at a time."""
    decoder = codecs.getincrementaldecoder("utf-8")(errors="ignore")
    with (gzip.GzipFile(fileobj=io.BytesIO(content)) if packed else io.BytesIO(content)) as file:
        while part := file.read(READ_BYTES):
            yield decoder.decode(part)


def _locations(pieces: Iterator[str]) -> list[str]:
    """Trimmed texts of all elements whose name ends in "loc"; finished elements are let go at once."""
    parser, found, around = ElementTree.XMLPullParser(("start", "end")), [], []

    def take() -> None:
        for event, element in parser.read_events():
            if event == "start":
                around.append(element)
                continue
            around.pop()
            if isinstance(element.tag, str) and element.tag.lower().endswith("loc") and (text := (element.text or "").strip()):
                found.append(text)
            if around:
                around[-1].remove(element)

    for piece in pieces:
        parser.feed(piece)
        take()
    parser.close()
    take()
    return found


def _read_file(content: bytes, packed: bool) -> tuple[list[str], str | None, str | None]:
    """Locations, kind of error and message. A packed file that cannot be unpacked is tried as it is."""
    problem = None
    if packed:
        try:
            return _locations(_pieces(content, True)), None, None
        except (gzip.BadGzipFile, EOFError, zlib.error) as error:
            problem = error
        except (ElementTree.ParseError, ValueError) as error:
            return [], type(error).__name__, str(error)
    try:
        return _locations(_pieces(content, False)), None, None
    except (ElementTree.ParseError, ValueError) as error:
        return [], type(problem or error).__name__, str(problem or error)


def listed_locations(files: DataFrame) -> DataFrame:
    """M4: ``job_id, sitemap_url, pos, loc`` of all locations, and a row with ``error_type, message`` for a file that cannot be read.

    ``files(job_id, url, content)``; a file whose address ends in ``.xml.gz`` is
    packed. A file with an error lists nothing, as if it were not there.
    """
    fields = pa.schema([("job_id", pa.string()), ("sitemap_url", pa.string()), ("pos", pa.int32()), ("loc", pa.string()), ("error_type", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job_id, url, content in zip(*(batch.column(name) for name in ("job_id", "url", "content")), strict=True):
                job_id, url = job_id.as_py(), url.as_py()
                found, kind, message = _read_file(content.as_py() or b"", (url or "").endswith(".xml.gz"))
                rows = [(job_id, url, pos, loc, None, None) for pos, loc in enumerate(found)] or ([(job_id, url, None, None, kind, message)] if kind else [])
                for at in range(0, len(rows), ROWS):
                    some = zip(*rows[at : at + ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(some, fields, strict=True)], schema=fields)

    return files.select("job_id", "url", "content").mapInArrow(run, "job_id string, sitemap_url string, pos int, loc string, error_type string, message string")


@arrow_udf(T.ArrayType(T.StringType()))
def _locs(bodies: pa.Array) -> pa.Array:
    # Any element whose name ends in "loc", at any depth and in any namespace:
    # from_xml would need every such path in its schema.
    found = []
    for body in bodies:
        try:
            root = ElementTree.fromstring(body.as_py() or "")
        except (ElementTree.ParseError, ValueError):
            found.append([])
            continue
        texts = [(e.text or "").strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.lower().endswith("loc")]
        found.append([text for text in texts if text])
    return pa.array(found, pa.list_(pa.string()))


def sitemap_locs(body: Column | str) -> Column:
    """M2: trimmed locations in document order, none for malformed XML."""
    return _locs(col(body))
