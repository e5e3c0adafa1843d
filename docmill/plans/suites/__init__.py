"""One module per group of operators; importing it registers the queries."""

from docmill.plans.suites import chunk, clean, extract, fuse, graph, pipelines, query, report, search  # noqa: F401
