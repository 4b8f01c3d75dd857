"""Queries of the program scans: one for each language, over a fixture that `events` repeats."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.programs import LANGUAGES, program_files
from ..sources.tables import table

# Fixed values: (language, program, paths read, paths written); the directory is /repo.
CASES = [
    ("python", "open('a.go').read(); open('/r/o.go','w')", ["/repo/a.go"], ["/r/o.go"]),
    ("python", "from pathlib import Path\nPath('/r/a.go').read_text()\nPath('b').write_text('x')", ["/r/a.go"], ["/repo/b"]),
    ("python", "open(f'{x}.go')\nopen(name)", [], []),
    ("python", 'import os\nfor r, d, f in os.walk("/abs/repo"): pass', [], []),  # names alone are no content
    ("python", 'import os\nfor r, d, f in os.walk("/abs/repo"):\n  for x in f: open(os.path.join(r, x))', ["/abs/repo"], []),
    ("javascript", "fs.readFileSync('/abs/y.js'); fs.writeFileSync('o.js', x)", ["/abs/y.js"], ["/repo/o.js"]),
    ("javascript", "fs.readFileSync(p); fs.readFileSync(`/a/${b}`); fs.readFileSync('/a\\\\b')", [], []),
    ("ruby", "File.read('/abs/y.rb')\nDir.glob('/abs/indexed/**/*.rb')\nFile.open('/abs/h.rb','w')", ["/abs/y.rb", "/abs/indexed"], ["/abs/h.rb"]),
    ("php", 'glob("/abs/indexed/*.php"); file_put_contents("o.txt", $x);', ["/abs/indexed"], ["/repo/o.txt"]),
    ("php", "fopen(mode: 'r', filename: '/etc/passwd');", [], []),
    ("perl", 'open(my $fh, "<", "data.txt"); open(FH, ">out2.txt"); open(X, "<&", "dup");', ["/repo/data.txt"], ["/repo/out2.txt"]),
    ("awk", '{ getline line < "data.txt"; print "x" > "out.txt"; getline < f }', ["/repo/data.txt"], ["/repo/out.txt"]),
    ("sed", "/pat/r inc.txt", ["/repo/inc.txt"], []),
    ("sed", "s/a/b/gw log.txt\n1,5w slice.txt\ns/w/x/g", [], ["/repo/log.txt", "/repo/slice.txt"]),
    ("sql", "ATTACH DATABASE '/other/aux.db' AS aux; SELECT readfile('/data/blob.bin');\n.import in.csv t\n.output off", ["/other/aux.db", "/data/blob.bin", "/repo/in.csv"], ["/dev/null"]),
    ("sql", ".output stdout\n.import --csv x t\nSELECT readfile(?1)", [], []),
    ("applescript", 'read POSIX file "/etc/hosts"\nwrite "data" to file "/data/out.txt"\nread file "Disk:x"\nread file "/a" & suffix', ["/etc/hosts"], ["/data/out.txt"]),
]


def _analyze(language: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(p, r, w) for lang, p, r, w in CASES if lang == language]
    text = F.get(F.array(*[F.lit(p) for p, *_ in own]), F.pmod("event_id", F.lit(len(own))).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(language).alias("lang"), text.alias("text"), F.lit("/repo").alias("cwd"), F.lit("/home/u").alias("home"))
    return program_files(rows, "event_id").where("resolvable").select("event_id", "access", "path")


def _sql(language: str) -> str:
    own = [(r, w) for lang, _, r, w in CASES if lang == language]
    rows = ", ".join(f"({i}, '{a}', '{p}')" for i, both in enumerate(own) for a, paths in zip(("read", "write"), both) for p in paths)
    return f"WITH x(k, access, path) AS (VALUES {rows}) SELECT event_id, access, path FROM events JOIN x ON event_id % {len(own)} = k"


QUERIES = {f"analyze_{x}": functools.partial(_analyze, x) for x in LANGUAGES}
SQL = {f"analyze_{x}": _sql(x) for x in LANGUAGES}
