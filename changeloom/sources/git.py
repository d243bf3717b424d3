"""Reading a git repository: the control plane runs git on the driver, bytes of
many blobs are read by one `cat-file --batch` for each partition."""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.schema import CHANGED_LINES, CHANGES, TOUCHES

DAY = 86_400
LOG_FORMAT = "%x01%H%x00%ct%x00%an%x00%ae"
_HEAD = re.compile(rb"([0-9a-f]{40,64})\x00(\d+)\x00([^\x00]*)\x00([^\x00]*)\x00")


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    settings = ["-c", "core.quotepath=off", "-c", "diff.renames=true", "-c", "color.ui=false"]
    return subprocess.run(["git", "-C", repo, *settings, *args], input=stdin, capture_output=True, check=True).stdout


def author_key(name: bytes, email: bytes) -> str:
    return hashlib.sha256(name + b"\x00" + email).hexdigest()[:16]


def parse_log(raw: bytes) -> Iterator[tuple[str, int, str, str, int | None, int | None]]:
    """Touches of a log written with LOG_FORMAT, --numstat and -z. A commit starts
    at a 0x01 that a valid header follows, so one in a path splits nothing; `-`
    counts are null."""
    starts = [m.start() + 1 for m in re.finditer(rb"(?:^|(?<=\x00)|(?<=\n))\x01", raw)]
    heads = [(at, m) for at in starts if (m := _HEAD.match(raw, at))]
    for (_, head), end in zip(heads, [*(at - 1 for at, _ in heads[1:]), len(raw)], strict=True):
        oid, when = head.group(1).decode(), int(head.group(2))
        who = author_key(head.group(3), head.group(4))
        for part in raw[head.end() : end].split(b"\x00"):
            fields = part.lstrip(b"\n").split(b"\t", 2)
            if len(fields) == 3:
                added, deleted = (None if f == b"-" else int(f) for f in fields[:2])
                yield oid, when, who, fields[2].decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), added, deleted


def history(spark: SparkSession, repo: str, anchor: str = "HEAD", window_days: int = 365) -> DataFrame:
    """Touches of the commits reachable from the anchor, up to window_days before
    it, bound included; merges and renames aren't followed."""
    anchor_at = int(git(repo, "show", "-s", "--format=%ct", anchor))
    cutoff = anchor_at - window_days * DAY
    raw = git(repo, "log", "--no-merges", "--no-renames", "--numstat", "-z", f"--since={cutoff}", f"--format={LOG_FORMAT}%x00", anchor)
    return spark.createDataFrame(list(parse_log(raw)), TOUCHES).filter(F.col("committed_at") >= cutoff)


def parse_raw_diff(raw: bytes) -> list[tuple]:
    """Changes of `diff-tree --raw -z`."""
    fields, out, k = raw.split(b"\x00"), [], 0
    while k + 1 < len(fields):
        head = fields[k].lstrip(b":").split()
        if len(head) != 5:
            k += 1
            continue
        status = head[4].decode()
        first = fields[k + 1].decode("utf-8", "replace")
        renamed = status[0] in "RC"
        path = fields[k + 2].decode("utf-8", "replace") if renamed else first
        k += 3 if renamed else 2
        names = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "added", "T": "modified"}
        out.append((path, first if renamed else None, names[status[0]], int(status[1:]) if status[1:] else None, *(x.decode() for x in head[:4])))
    return sorted(out)


def changed_set(spark: SparkSession, repo: str, base: str, head: str = "HEAD") -> DataFrame:
    return spark.createDataFrame(parse_raw_diff(git(repo, "diff-tree", "-r", "--raw", "-z", "-M", "--no-abbrev", base, head)), CHANGES)


def dirty_set(spark: SparkSession, repo: str, full: bool = False) -> DataFrame:
    """(path, base_oid, head_oid) of the work tree against HEAD: by status, or by
    hashing every file of the index. Absent sides are null; what turns out equal
    is left out."""
    tree = {p: oid for p, oid in parse_ls_tree(git(repo, "ls-tree", "-r", "-z", "HEAD"))}
    if full:
        paths = [p.decode() for p in git(repo, "ls-files", "-z").split(b"\x00") if p]
    else:
        status = git(repo, "status", "--porcelain=v2", "-z", "--no-renames", "--untracked-files=all").split(b"\x00")
        paths = [x.decode().split(" ", 8)[-1] if x[:1] == b"1" else x.decode()[2:] for x in status if x[:1] in (b"1", b"?")]
    import os

    there = [p for p in paths if os.path.isfile(os.path.join(repo, p))]
    hashed = git(repo, "hash-object", "--stdin-paths", stdin="\n".join(there).encode()).decode().split() if there else []
    now = dict(zip(there, hashed, strict=True))
    rows = [(p, tree.get(p), now.get(p)) for p in sorted(set(paths) | (set(tree) if full else set())) if tree.get(p) != now.get(p)]
    return spark.createDataFrame(rows, "path string, base_oid string, head_oid string")


def parse_ls_tree(raw: bytes) -> list[tuple[str, str]]:
    """(path, oid) of blobs."""
    out = []
    for row in raw.split(b"\x00"):
        meta, tab, path = row.partition(b"\t")
        parts = meta.split()
        if tab and len(parts) >= 3 and parts[1] == b"blob":
            out.append((path.decode("utf-8", "replace"), parts[2].decode()))
    return out


def tree(spark: SparkSession, repo: str, rev: str = "HEAD") -> DataFrame:
    return spark.createDataFrame(parse_ls_tree(git(repo, "ls-tree", "-r", "-z", rev)), "path string, blob_oid string")


def blobs(oids: DataFrame, repo: str) -> DataFrame:
    """oids(blob_oid) with content, null where the repository lacks it. The
    repository must be readable by executors (a shared mount); one process reads
    all blobs of a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for part in parts:
                found = []
                for oid in part["blob_oid"]:
                    reader.stdin.write(f"{oid}\n".encode())
                    reader.stdin.flush()
                    head = reader.stdout.readline().split()
                    if len(head) == 3:
                        found.append(reader.stdout.read(int(head[2])))
                        reader.stdout.read(1)
                    else:
                        found.append(None)
                yield pd.DataFrame({"blob_oid": part["blob_oid"], "content": found})
        finally:
            reader.stdin.close()
            reader.wait()

    return oids.select("blob_oid").distinct().mapInPandas(run, "blob_oid string, content binary")


def blob_oid(content):
    """The object id of a blob's bytes, as a column."""
    size = F.octet_length(content).cast("string")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), size.cast("binary"), F.unhex(F.lit("00")), content))


def hunk_lines(diffs: DataFrame, path: str = "path", diff: str = "diff") -> DataFrame:
    """(path, line) of the destination lines of unified diffs without context."""
    spans = F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), F.lit(1))
    span = diffs.select(path, F.explode(spans).alias("__span"))
    start = F.element_at(F.split("__span", ","), 1).cast("int")
    count = F.coalesce(F.try_element_at(F.split("__span", ","), F.lit(2)).cast("int"), F.lit(1))
    lines = F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))
    return span.select(path, F.explode(lines).alias("line")).distinct()


def changed_lines(spark: SparkSession, repo: str, base: str, head: str = "HEAD") -> DataFrame:
    raw = git(repo, "diff", "--unified=0", "--no-renames", base, head).decode("utf-8", "replace")
    rows = []
    for part in re.split(r"(?m)^diff --git ", raw)[1:]:
        if found := re.search(r"(?m)^\+\+\+ b/(.*)$", part):
            rows.append((found.group(1), part))
    diffs = spark.createDataFrame(rows, "path string, diff string")
    return spark.createDataFrame([], CHANGED_LINES).union(hunk_lines(diffs))


def file_changes(spark: SparkSession, repo: str, base: str, head: str = "HEAD") -> DataFrame:
    """(path, old_path, kind, base, head): both sides' bytes of a change."""
    from changeloom.operators.changes import readable

    changes = changed_set(spark, repo, base, head)
    wanted = changes.select(F.col("old_mode").alias("new_mode"), F.col("old_oid").alias("new_oid")).union(changes.select("new_mode", "new_oid"))
    held = blobs(readable(wanted).select(F.col("new_oid").alias("blob_oid")), repo)
    return (
        changes.join(held.toDF("old_oid", "base"), "old_oid", "left")
        .join(held.toDF("new_oid", "head"), "new_oid", "left")
        .select("path", "old_path", F.col("status").alias("kind"), "base", "head")
    )


def notes(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(commit, line) of the notes under a ref."""
    listed = [x.split() for x in git(repo, "notes", f"--ref={ref}", "list").decode().splitlines()]
    rows = [(commit, line) for note, commit in sorted(listed, key=lambda x: x[1]) for line in git(repo, "cat-file", "blob", note).decode().splitlines() if line.strip()]
    return spark.createDataFrame(rows, "commit string, line string")


def notes_history(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(line, committed_at) for every line of every note in each notes commit."""
    rows, seen = [], set()
    full = ref if ref.startswith("refs/") else f"refs/notes/{ref}"
    for row in git(repo, "log", "--reverse", "--format=%H %ct", full).decode().splitlines():
        commit, when = row.split()
        for _, oid in parse_ls_tree(git(repo, "ls-tree", "-r", "-z", commit)):
            if oid not in seen:
                seen.add(oid)
                rows += [(line, int(when)) for line in git(repo, "cat-file", "blob", oid).decode().splitlines() if line.strip()]
    return spark.createDataFrame(rows, "line string, committed_at long")


BASE_CANDIDATES = ["@{upstream}", "origin/HEAD", "origin/main", "origin/master", "main", "master", "HEAD~1"]


def resolve_base(repo: str, candidates: list[str] = BASE_CANDIDATES) -> tuple[str, str] | None:
    """(oid, name) of the first candidate whose merge base with HEAD differs from
    HEAD by a non-empty diff."""
    for name in candidates:
        try:
            base = git(repo, "merge-base", "HEAD", name).decode().strip()
            if git(repo, "diff-tree", "-r", "--raw", base, "HEAD").strip():
                return base, name
        except subprocess.CalledProcessError:
            continue
    return None


def is_ancestor(repo: str, oid: str, of: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", oid, of], capture_output=True).returncode == 0


def sync_notes(repo: str, ref: str, remote: str = "origin", attempts: int = 6, wait=None) -> int:
    """Fetch, merge by union of lines, push; again after a growing delay where
    the push is refused. The number of attempts used; an error when they run out."""
    import time

    from changeloom.functions.scalars import retry_delay_ms

    full = ref if ref.startswith("refs/") else f"refs/notes/{ref}"
    for attempt in range(1, attempts + 1):
        try:
            git(repo, "fetch", remote, f"+{full}:refs/notes/incoming")
            git(repo, "notes", f"--ref={full}", "merge", "-s", "cat_sort_uniq", "refs/notes/incoming")
        except subprocess.CalledProcessError as e:
            if b"couldn't find remote ref" not in e.stderr:
                raise
        try:
            git(repo, "push", remote, f"{full}:{full}")
            return attempt
        except subprocess.CalledProcessError:
            (wait or time.sleep)(retry_delay_ms(attempt) / 1000)
    raise RuntimeError(f"the push of {full} was refused {attempts} times")
