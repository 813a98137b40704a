"""Which file uses which, in Python, JavaScript, Go and Rust: imports, resolved as each language does.

Python reads each file on its own and tells its imports with the places that
could be meant, best first: for JavaScript the path beside the file, with the
suffixes of modules or an index file in a folder; for Python the path from the
file's folder, or from any folder above it; for Rust the module's file below the
crate's ``src``, with ever shorter paths; for Go the import path itself. Joins
say which of the places are there: files by path, Go packages by the module that
a ``go.mod`` above them names. The first place that is there counts. What no file
provides is a package from elsewhere, told by its name.
"""

from __future__ import annotations

import ast
import posixpath
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_scan
from .token_scan import unquoted

SCRIPTS = ("js", "mjs", "cjs", "ts", "tsx", "jsx")
SCHEMA = "path string, line_no int, language string, spec string, package string, candidates array<string>"
GATE = r"import|require|\buse\b|\bmod\b|export"


def python_imports(path: str, content: str) -> list[tuple]:
    folder, out = posixpath.dirname(path), []
    above = [folder]
    while above[-1]:
        above.append(posixpath.dirname(above[-1]))

    def files(base: str, parts: list[str]) -> list[str]:
        at = posixpath.join(base, *parts) if parts else base
        return [f"{at}.py", f"{at}/__init__.py"] if parts else [f"{at}/__init__.py".lstrip("/")]

    for node in ast.walk(ast.parse(content)):
        if isinstance(node, ast.Import):
            for a in node.names:
                parts = a.name.split(".")
                out.append((node.lineno, a.name, parts[0], [f for base in above for f in files(base, parts)]))
        elif isinstance(node, ast.ImportFrom):
            parts = (node.module or "").split(".") if node.module else []
            bases = above
            if node.level:
                base = folder
                for _ in range(node.level - 1):
                    base = posixpath.dirname(base)
                bases = [base]
            spec = "." * node.level + (node.module or "")
            for a in node.names:  # a name may be a module of the package
                out.append((node.lineno, f"{spec}:{a.name}", parts[0] if parts and not node.level else "", [f for base in bases for f in [*files(base, [*parts, a.name]), *files(base, parts)]]))
    return out


def script_imports(path: str, content: str) -> list[tuple]:
    source, out = token_scan.Source(content, "javascript"), []
    for i, (t, line, _) in enumerate(source.tokens):
        spec = None
        if t in ("require", "import") and source.at(i + 1) == "(" and source.at(i - 1) != ".":
            spec = unquoted(source.at(i + 2)) if source.at(i + 3) == ")" else None
        elif t == "import" and source.at(i - 1) != ".":
            spec = unquoted(source.at(i + 1)) or _from(source, i)
        elif t == "export" and source.at(i + 1) in ("{", "*"):
            spec = _from(source, i)
        if not spec:
            continue
        places, package = [], "/".join(spec.split("/")[: 2 if spec.startswith("@") else 1])
        if spec.startswith("."):
            at, package = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec)), ""
            bare = re.sub(r"\.[cm]?jsx?$", "", at)  # a compiled name may stand for its source
            places = [at, *[f"{at}.{s}" for s in SCRIPTS], *([f"{bare}.{s}" for s in ("ts", "tsx")] if bare != at else []), *[posixpath.normpath(f"{at}/index.{s}") for s in SCRIPTS]]
        out.append((line, spec, package, places))
    return out


def _from(source: token_scan.Source, i: int) -> str | None:
    """The literal after ``from`` in the statement that begins at token i."""
    for j in range(i + 1, len(source.tokens)):
        if source.at(j) == "from" and unquoted(source.at(j + 1)) is not None:
            return unquoted(source.at(j + 1))
        if source.at(j) in (";", "=", "(", "import", "export"):
            return None
    return None


def go_imports(path: str, content: str) -> list[tuple]:
    source = token_scan.Source(content, "go")
    lines = {unquoted(t): line for t, line, _ in reversed(source.tokens) if unquoted(t)}
    return [(lines.get(spec, 1), spec, spec, []) for spec in dict.fromkeys(source.imports.values())]


def rust_imports(path: str, content: str) -> list[tuple]:
    source, out = token_scan.Source(content, "rust"), []
    root, _, inner = path.rpartition("src/")
    root += "src" if path.startswith("src/") or "/src/" in path else posixpath.dirname(path)
    own = re.sub(r"(/mod|^mod|^lib|^main)?\.rs$", "", inner or posixpath.basename(path))
    own = [p for p in own.split("/") if p]

    def files(parts: list[str]) -> list[str]:
        """Modules of ever shorter paths: the last names may be items."""
        return [f for k in range(len(parts), 0, -1) for at in [posixpath.join(root, *parts[:k])] for f in (f"{at}.rs", f"{at}/mod.rs")] + [f"{root}/lib.rs", f"{root}/main.rs"]

    for i, (t, line, _) in enumerate(source.tokens):
        if t == "mod" and source.at(i + 2) == ";":
            out.append((line, f"mod {source.at(i + 1)}", "", files([*own, source.at(i + 1)])[:2]))
        elif t == "use" and source.at(i - 1) not in (".", "::"):
            for names in _paths(source, i + 1):
                at = list(own)
                if names[0] in ("crate", "self", "super"):
                    head = names[0]
                    at = [] if head == "crate" else at
                    while names and names[0] in ("crate", "self", "super"):
                        at = at[:-1] if names[0] == "super" else at
                        names = names[1:]
                    out.append((line, "::".join([head, *names]), "", files([*at, *names])))
                else:
                    out.append((line, "::".join(names), names[0], files([*own, *names])[: 2 * len(names)] if len(names) else []))
    return out


def _paths(source: token_scan.Source, i: int, before: tuple[str, ...] = (), depth: int = 0) -> list[list[str]]:
    """The paths of a ``use``, groups in braces one by one."""
    names, j = list(before), i
    while source.at(j) not in (";", ",", "}", ""):
        t = source.at(j)
        if t == "{" and depth < 20:
            out, level, k = [], 0, j
            while k < len(source.tokens):
                if source.at(k) == "{":
                    level += 1
                elif source.at(k) == "}":
                    level -= 1
                    if not level:
                        break
                if level == 1 and source.at(k) in ("{", ",") and source.at(k + 1) != "}":
                    out += _paths(source, k + 1, tuple(names), depth + 1)
                k += 1
            return out
        if t == "as":
            break
        if re.fullmatch(r"[A-Za-z_]\w*", t) and not (t == "self" and names):
            names.append(t)
        j += 1
    return [names] if names else []


READERS = {"python": python_imports, "javascript": script_imports, "go": go_imports, "rust": rust_imports}
LANGUAGES = {"py": "python", "go": "go", "rs": "rust"} | dict.fromkeys(SCRIPTS, "javascript")


def _read(batches):
    for batch in batches:
        rows = []
        for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                rows += [(path, line, language, spec, package, list(dict.fromkeys(places))) for line, spec, package, places in READERS[language](path, content)]
            except (SyntaxError, ValueError, RecursionError):
                continue  # what does not parse imports nothing
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])


def _language(path) -> F.Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def imports(files: DataFrame) -> DataFrame:
    """A row for each import of files (path, content), with the places that it could mean."""
    kept = files.select("path", _language(F.col("path")).alias("language"), "content").where(F.col("language").isNotNull() & F.col("content").rlike(GATE))
    return kept.mapInArrow(_read, SCHEMA)


def _folder(path) -> F.Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _is_go(path) -> F.Column:
    return F.endswith(F.lower(path), F.lit(".go"))


def go_packages(files: DataFrame) -> DataFrame:
    """(path, spec, src, external): the files of the package that a Go import names, by the module whose name begins it; the longest name counts. Without such files the import itself."""
    module = F.regexp_extract("content", r"(?m)^\s*module\s+\"?([^\s\"]+)", 1)
    modules = files.where(F.col("path").rlike(r"(^|/)go\.mod$") & F.col("content").isNotNull()).select(_folder(F.col("path")).alias("root"), module.alias("module")).where("module <> ''")
    parts = F.split("spec", "/")
    wanted = imports(files.where(_is_go(F.col("path")))).select("path", "spec").where("spec <> ''")
    prefixes = wanted.select("path", "spec", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).withColumns({"module": F.array_join(F.slice(parts, 1, F.col("k")), "/"), "rest": F.array_join(F.slice(parts, F.col("k") + 1, 1000), "/")})
    # of several modules of one name the one that the importing file is in, else the first
    inside = F.startswith("path", F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))))
    met = prefixes.join(modules.hint("merge"), "module", "left").where("root IS NOT NULL OR k = 1")
    best = met.groupBy("path", "spec").agg(F.max_by(F.struct("root", "rest"), F.when(F.col("root").isNotNull(), F.struct("k", inside, F.length("root")))).alias("x"))
    folder = F.concat_ws("/", F.when(F.col("x.root") != "", F.col("x.root")), F.when(F.col("x.rest") != "", F.col("x.rest")))
    # no path holds a NUL: an import without a module meets no folder, and many of them no common key
    at = best.select("path", "spec", F.when(F.col("x.root").isNotNull(), folder).otherwise(F.concat(F.lit("\0"), "path")).alias("at"))
    members = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select(F.col("path").alias("src"), _folder(F.col("path")).alias("folder")).distinct()
    found = at.join(members.hint("merge"), (F.col("at") == F.col("folder")) & (F.col("src") != F.col("path")), "left")
    return found.select("path", "spec", F.coalesce("src", "spec").alias("src"), F.col("src").isNull().alias("external"))


def resolved(files: DataFrame) -> DataFrame:
    """(src, dst, spec, language, external): ``dst`` uses ``src``, a file, or the name of a package that no file provides.

    Each file is read for its imports once, and their places are dealt out once:
    the package stands behind them with the file's own path, which is there, so
    that it counts where no place does. The joins are asked to merge: both sides
    grow with the files, and sizes guessed behind Python would have them broadcast.
    """
    there = files.select(F.col("path").alias("place")).distinct()
    n = F.size("candidates")
    places = imports(files.where(~_is_go(F.col("path")))).select("path", "spec", "package", n.alias("n"), F.posexplode(F.array_append("candidates", F.col("path"))).alias("at", "place"))
    places = places.where("at < n AND place <> path OR at = n AND package <> ''").select("path", "spec", "at", "place", F.when(F.col("at") == F.col("n"), F.col("package")).alias("package"))
    first = places.join(there.hint("merge"), "place").groupBy("path", "spec").agg(F.min_by(F.struct("place", "package"), "at").alias("x"))
    inner = first.select("path", _language(F.col("path")).alias("language"), "spec", F.coalesce("x.package", "x.place").alias("src"), F.col("x.package").isNotNull().alias("external"))
    packages = go_packages(files).select("path", F.lit("go").alias("language"), "spec", "src", "external")
    return inner.unionByName(packages).select("src", F.col("path").alias("dst"), "spec", "language", "external")


def by_stem(edges: DataFrame) -> DataFrame:
    """(src, dst) of a dependency network whose nodes are files' names without folder and suffix."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)
    return edges.select(F.when(F.col("external"), F.col("src")).otherwise(stem("src")).alias("src"), stem("dst").alias("dst")).where("src <> dst").distinct()
