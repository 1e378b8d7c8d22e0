"""A small source tree with imports of every language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = {
    "go.mod": "module example.com/app\n\ngo 1.22\n",
    "README.md": "# App\nSee docs/guide.md for more.\n",
    "docs/guide.md": "Guide.\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tp "example.com/app/go/pkg"\n)\n\nfunc main() { fmt.Println(p.A()) }\n',
    "go/pkg/a.go": "package pkg\n\n// A gives one.\nfunc A() int { return 1 }\n\n// T is a pair.\ntype T struct {\n\tx, y int\n\tname string\n}\n\ntype I interface {\n\tDo(a int) error\n}\n\nconst K int = 3\n",
    "go/pkg/b.go": "package pkg\n\nvar b, c = A(), 2\n\nfunc (t *T) Sum(z int) (int, error) {\n\treturn t.x + z, nil\n}\n",
    "go/pkg/a_test.go": "package pkg\n",
    "src/a.ts": 'import { b } from "./b";\nimport lib from \'./lib\';\nimport "react";\n/** Says a. */\nexport const a = () => b;\n',
    "src/b.ts": "export const b = 1;\n",
    "src/c.js": "const a = require('./a');\nconst d = import( './d.mjs' );\nconst x = require('./missing');\n",
    "src/d.mjs": "export default 1;\n",
    "src/lib/index.tsx": "export { b } from '../b';\n",
    "app/main.php": "<?php\nrequire './util.php';\ninclude_once('../lib/db');\nrequire $dynamic;\ninclude '/etc/passwd';\n",
    "app/util.php": "<?php\n",
    "lib/db.php": "<?php\n",
    "pkg/__init__.py": "",
    "pkg/main.py": "import pkg.util as u, os\nfrom pkg.sub import (helper)\n\nfrom . import local  # beside\n",
    "pkg/util.py": "class U:\n    x = 1\n",
    "pkg/local.py": "class Local:\n    pass\n",
    "pkg/sub/helper.py": "",
    "pkg/sub/worker.py": "x = 0\nfrom .. import util  # the parent\n",
}


def repo(spark: SparkSession, files: dict[str, str] | None = None) -> DataFrame:
    rows = [(p, c, i) for i, (p, c) in enumerate((FILES if files is None else files).items())]
    x = spark.createDataFrame(rows, "path string, content string, mod_time long")
    return x.withColumn("size", F.octet_length("content").cast("long"))


def symbol_uses(spark: SparkSession) -> DataFrame:
    """Package a uses pkg's symbols twice; pkg's own files use each other's."""
    rows = [("main", "cmd/main.go", "go/pkg/a.go", 2), ("pkg", "go/pkg/b.go", "go/pkg/a.go", 4), ("pkg", "go/pkg/a.go", "go/pkg/b.go", 9)]
    return spark.createDataFrame(rows, "package string, file string, def_file string, n long")
