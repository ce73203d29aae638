"""All registered queries."""

from rowscribe.plans import (  # noqa: F401
    catalog_annotation,
    catalog_columns,
    catalog_events,
    catalog_relational,
    catalog_scan,
    catalog_streams,
)

FLAGSHIP = "ann01_annotation_summary"
