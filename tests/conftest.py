import pytest

from pagemill.operators.jobs import JOB_SCHEMA, prepare_jobs
from pagemill.session import local_session
from pagemill.sources.responses import as_responses


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def make_jobs(spark):
    def build(*rows: dict):
        defaults = dict(
            job_id="default", start_url="https://example.com", allowed_domains=["example.com"], include_patterns=[],
            exclude_patterns=[], attachment_extensions=[".pdf"], max_pages=None, max_depth=None, content_extraction=None,
            save_html=None, save_markdown=None, download_attachments=None,
        )
        return prepare_jobs(spark.createDataFrame([tuple({**defaults, **row}.values()) for row in rows], JOB_SCHEMA))

    return build


@pytest.fixture
def make_responses(spark):
    def build(*rows: tuple, schema: str = "page_id long, url string, html string"):
        return as_responses(spark.createDataFrame(list(rows), schema))

    return build
