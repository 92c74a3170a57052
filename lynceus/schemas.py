"""Explicit schemas of every DataFrame the library reads or returns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FILES = _struct(("path", _S), ("code", _S), ("language", _S), ("ext", _S))

WORKSPACE_FILE = _struct(("path", _S), ("code", _S), ("language", _S))
WORKSPACE_REQUEST = _struct(
    ("files", T.ArrayType(WORKSPACE_FILE)), ("engines", T.ArrayType(_S))
)

LINES = _struct(("path", _S), ("language", _S), ("line_no", _I), ("line", _S))

RULES = _struct(
    ("rule_id", _S),
    ("engine", _S),
    ("ord", _I),
    ("title", _S),
    ("pattern", _S),
    ("severity", _S),
    ("sev_rank", _I),
    ("cwe_id", _S),
    ("description", _S),
    ("scope", _S),
)

FINDINGS = _struct(
    ("finding_id", _S),
    ("engine", _S),
    ("rule_id", _S),
    ("cve_id", _S),
    ("cwe_id", _S),
    ("severity", _S),
    ("sev_rank", _I),
    ("title", _S),
    ("explanation", _S),
    ("vulnerable_code", _S),
    ("fixed_code", _S),
    ("description", _S),
    ("line_start", _I),
    ("line_end", _I),
    ("file_path", _S),
    ("detected_at", T.TimestampType()),
)

DEPENDENCIES = _struct(
    ("file_path", _S), ("name", _S), ("version", _S), ("ecosystem", _S)
)

# Tables may also have last_affected, the last version inside a range.
ADVISORIES = _struct(
    ("advisory_id", _S),
    ("cve_id", _S),
    ("ecosystem", _S),
    ("package_name", _S),
    ("introduced", _S),
    ("fixed", _S),
    ("severity", _S),
    ("summary", _S),
    ("source", _S),
)

VULNERABILITIES = _struct(
    ("cve_id", _S),
    ("cwe_id", _S),
    ("severity", _S),
    ("title", _S),
    ("description", _S),
    ("published_at", T.TimestampType()),
    ("last_modified_at", T.TimestampType()),
    ("data_source", _S),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
    ("ecosystem", _S),
    ("package_name", _S),
)

SCANS = _struct(
    ("scan_id", _S),
    ("language", _S),
    ("target_name", _S),
    ("findings_count", _I),
    ("severity_counts", T.MapType(_S, _L)),
    ("created_at", T.TimestampType()),
)

# Feed documents, as published. Only the fields used downstream are declared,
# so the JSON reader skips everything else.
NVD_FEED = _struct(
    (
        "vulnerabilities",
        T.ArrayType(
            _struct(
                (
                    "cve",
                    _struct(
                        ("id", _S),
                        (
                            "descriptions",
                            T.ArrayType(_struct(("lang", _S), ("value", _S))),
                        ),
                        (
                            "metrics",
                            _struct(
                                (
                                    "cvssMetricV31",
                                    T.ArrayType(
                                        _struct(
                                            ("cvssData", _struct(("baseSeverity", _S)))
                                        )
                                    ),
                                )
                            ),
                        ),
                    ),
                )
            )
        ),
    )
)

OSV_RECORD = _struct(
    ("id", _S),
    ("summary", _S),
    ("aliases", T.ArrayType(_S)),
    ("severity", T.ArrayType(_struct(("type", _S), ("score", _S)))),
    (
        "affected",
        T.ArrayType(
            _struct(
                ("package", _struct(("name", _S), ("ecosystem", _S))),
                (
                    "ranges",
                    T.ArrayType(
                        _struct(
                            ("type", _S),
                            (
                                "events",
                                T.ArrayType(_struct(("introduced", _S), ("fixed", _S), ("last_affected", _S))),
                            ),
                        )
                    ),
                ),
                ("versions", T.ArrayType(_S)),
            )
        ),
    ),
)

ANALYZER_REPORT = _struct(
    (
        "results",
        T.ArrayType(
            _struct(
                ("check_id", _S),
                ("path", _S),
                ("start", _struct(("line", _I), ("col", _I))),
                (
                    "extra",
                    _struct(
                        ("severity", _S),
                        ("message", _S),
                        ("metadata", _struct(("cve", _S))),
                    ),
                ),
            )
        ),
    )
)

SCAN_EVENT = _struct(("scan_id", _S), ("seq", _L), ("type", _S), ("data", _S), ("at", T.TimestampType()))
