"""Where the values of cryptographic calls come from and where they go, from source texts.

A file gives ingress events (environment and configuration reads), nexus events
(cryptographic calls, each with the dynamic value it takes, if any) and egress
events (stores, caches, streams, ledgers). Values that are known constants are
no lineage. Edges follow inside a file: what feeds a call, and what may keep it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_scan import CONFIGS, Source, unquoted

LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript", "tsx": "javascript", "py": "ruby", "go": "go", "java": "java"}  # Python comments are as Ruby's
SCHEMA = "path string, line_no int, category string, source_type string, node_id string, fed_by string"
GATE = r"(?i)crypto|cipher|getInstance|generateKeyPair|ml_dsa|ml_kem|rsa_?blind|env|config|settings|redis|xadd|client|transaction|submit|db\.|repository|prisma|sequelize|orm\."

# --- fixed values: names that are no ingress, and calls that keep what they are given
PLAIN_NAMES = frozenset(("NODE_ENV", "PORT", "LOG_LEVEL", "PATH", "PYTHONPATH", "JAVA_HOME"))
STORES = [
    (r"(redisClient|redis|client)\.(set|setEx|hSet|lPush|LPUSH)", "CACHE", "redis_store"), (r"(gateway|network|contract)\.(submitTransaction|evaluateTransaction|submit)", "LEDGER", "fabric"),
    (r"(db|repository|orm|prisma|sequelize)\.(insert|save|update|create)", "DATABASE", "sql_store"), (r"(.*\.)?(XADD|xadd|xAdd)", "STREAM", "redis_stream"),
]
CALLS = re.compile(
    r".*\.createCipheriv|.*\.generateKeyPair(Sync)?|ml_(dsa44|dsa65|dsa87|kem768|kem1024)\.(keygen|sign|verify|encapsulate|decapsulate)|(rsaBlindService|rsa_blind_service)\.(signBlinded|verifyAsync)"
    r"|(.*\.)?(Cipher|KeyGenerator|SecretKeyFactory|MessageDigest|Signature|Mac)\.getInstance"
)


def events(text: str, path: str, language: str) -> list[tuple[int, str, str, str, str | None]]:
    """(line, category, source type, node, what feeds it) in the order of the text; ledgers are one node for all files."""
    s = Source(text, language)
    out = []
    for i, chain, j in s.chains():
        line = s.tokens[i][1]
        if chain.startswith(("process.env", "os.environ", "os.getenv", "System.getenv")):
            key = chain.split(".")[2] if chain.startswith("process.env.") else unquoted(s.at(j + 1)) or ""
            key = unquoted(s.at(j + 3)) or "" if chain == "os.environ.get" and not key else key
            if key and key not in PLAIN_NAMES and key != "get":
                out.append((line, "INGRESS", "ENV", f"INGRESS:ENV:{key}", None))
        elif chain.split(".")[0] in CONFIGS and chain.endswith(".get"):
            key = unquoted(s.at(j + 1))
            if key:
                out.append((line, "INGRESS", "CONFIG", f"INGRESS:CONFIG:{key}", None))
        for pattern, kind, name in STORES:
            if re.fullmatch(pattern, chain):
                out.append((line, "EGRESS", kind, f"EGRESS:{kind}:{name}" + ("" if kind == "LEDGER" else f":{path}"), None))
        if CALLS.fullmatch(chain):
            args = s.arguments(j) if s.at(j) == "(" else []
            v = s.value(args[0]) if args else None
            dynamic = v is not None and v.origin in ("ENV", "CONFIG", "DATABASE", "PARAMETER")
            out.append((line, "NEXUS", "CALLSITE", f"NEXUS:{path}:{line}", f"INGRESS:{v.origin}:{v.key}" if dynamic else None))
    return out


def _scanned(batches):
    for batch in batches:
        rows = []
        for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows += [(path, *e) for e in events(content, path, language)]
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])


def lineage_events(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), suffix)
    wanted = files.select("path", language.alias("language"), "content").where(F.col("language").isNotNull() & F.col("content").rlike(GATE))
    return wanted.mapInArrow(_scanned, SCHEMA)


def lineage_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, category, source_type) and edges (source_id, target_id, edge_type); nodes without an edge go.

    A call is fed by the value it takes and by what its file reads, and reaches
    what its file keeps things in.
    """
    nexus = found.where("category = 'NEXUS'").select("path", "node_id", "fed_by")
    taken = nexus.where("fed_by IS NOT NULL").select(F.col("fed_by").alias("source_id"), F.col("node_id").alias("target_id"))
    read = found.where("category = 'INGRESS'").select("path", F.col("node_id").alias("source_id")).distinct()
    kept = found.where("category = 'EGRESS'").select("path", F.col("node_id").alias("target_id")).distinct()
    at = nexus.select("path", "node_id").distinct()
    feeds = taken.unionByName(at.join(read, "path").select("source_id", F.col("node_id").alias("target_id"))).distinct().withColumn("edge_type", F.lit("FEEDS"))
    reaches = at.join(kept, "path").select(F.col("node_id").alias("source_id"), "target_id").distinct().withColumn("edge_type", F.lit("REACHES"))
    edges = feeds.unionByName(reaches)
    ends = edges.select(F.col("source_id").alias("node_id")).union(edges.select(F.col("target_id").alias("node_id"))).distinct()
    parts = F.split("node_id", ":")
    nodes = ends.select("node_id", F.get(parts, F.lit(0)).alias("category"), F.when(F.get(parts, F.lit(0)) == "NEXUS", "CALLSITE").otherwise(F.get(parts, F.lit(1))).alias("source_type"))
    return nodes, edges
