"""Running a repository's own test command, on the driver, with a scrubbed
environment. A command that doesn't end in time is unanswered, never a failure."""

from __future__ import annotations

import os
import signal
import subprocess

from pyspark.sql import DataFrame, SparkSession

#: Environment names that a command may see besides those a policy allows.
KEPT = ["PATH", "HOME", "LANG", "TMPDIR"]
TAIL = 16 << 10
ROWS = "metric_id string, path string, kind string, number double, flag boolean, said string, completeness string"


def run_suite(command: str, folder: str, timeout_s: float, allow: list[str] | None = None) -> tuple[int | None, str]:
    """(exit code or None, the output's tail). The whole process group is killed
    at the time limit."""
    env = {k: os.environ[k] for k in [*KEPT, *(allow or [])] if k in os.environ}
    run = subprocess.Popen(command, shell=True, cwd=folder, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, start_new_session=True)
    try:
        out, _ = run.communicate(timeout=timeout_s)
        return run.returncode, out[-TAIL:].decode("utf-8", "replace")
    except subprocess.TimeoutExpired:
        os.killpg(run.pid, signal.SIGKILL)
        out, _ = run.communicate()
        return None, out[-TAIL:].decode("utf-8", "replace")


def suite_results(spark: SparkSession, command: str, folder: str, timeout_s: float, allow: list[str] | None = None) -> DataFrame:
    """The rows tests.suite-failure and tests.suite-outcome; without an answer
    both are absences."""
    code, _ = run_suite(command, folder, timeout_s, allow)
    if code is None:
        rows = [(f"tests.suite-{m}", None, "text", None, None, "timed out", "unwitnessed") for m in ("failure", "outcome")]
    else:
        said = "passed" if code == 0 else f"exited {code}"
        rows = [("tests.suite-failure", None, "flag", None, code != 0, None, "complete"), ("tests.suite-outcome", None, "text", None, None, said, "complete")]
    return spark.createDataFrame(rows, ROWS)
