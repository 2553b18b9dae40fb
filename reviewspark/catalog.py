"""All queries outside the subpackage of corpus operators, with their SQL."""

from reviewspark import queries_batch, queries_files, queries_online, queries_panel, queries_reports, queries_stores  # noqa: F401 - they register their queries
from reviewspark.queries import QUERIES, SQL  # noqa: F401
