"""Row types of the engine's tables, and their version."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A store written by a newer version is refused.
SCHEMA_VERSION = 12
#: A change of extraction rules forces a full rebuild.
EXTRACTOR_VERSION = 1


def _of(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"l": T.LongType(), "i": T.IntegerType(), "s": T.StringType(), "d": T.DoubleType(), "b": T.BooleanType()}[k]) for n, k in (x.split(":") for x in text.split())])


NODES = _of("id:l repo_id:s path:s symbol:s kind:s line_start:i line_end:i signature:s")
EDGES = _of("src:l dst:l kind:s weight:d extractor:s resolution_kind:s")
RAW_REFS = _of("repo_id:s path:s source:s name:s kind:s is_member:b")
UNRESOLVED = _of("repo_id:s path:s short_name:s")
SPANS = _of("trace_id:s span_id:s parent_span_id:s service:s name:s symbol:s path:s start_us:l duration_us:l status:s")
NOTES = _of("id:l target_node_id:l moniker:s kind:s tier:s author:s content:s content_hash:s stale:b expires_at:l created_at:l")
CONTRACTS = _of("service_a:s service_b:s protocol:s symbol:s entry_kind:s signature:s path:s line:i contract_hash:s source_sha:s published_at:l")
DOC_LINKS = _of("doc_id:l section:s target_node_id:l kind:s provenance_commit:s provenance_hash:s provenance_signature:s")
REVIEWS = _of("id:l base:s head:s risk:s findings:s waived:s reason:s created_at:l")
TABLES = {"nodes": NODES, "edges": EDGES, "raw_refs": RAW_REFS, "unresolved_refs": UNRESOLVED, "spans": SPANS, "notes": NOTES, "contracts": CONTRACTS, "doc_links": DOC_LINKS, "reviews": REVIEWS}


@dataclass
class GraphTables:
    """The tables that operators take; only nodes and edges are always there."""

    nodes: DataFrame
    edges: DataFrame
    more: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["more"][name]
        except KeyError:
            raise AttributeError(name) from None
