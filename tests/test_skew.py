"""A route holding a third of all transfers does not land in one task.

Runs ``tools/stage_profile.py`` in its own process (it needs a session with
the event log on) and reads the per-stage shuffle distribution.
"""

import json
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def stages():
    out = subprocess.run(
        [sys.executable, str(ROOT / "tools" / "stage_profile.py"), "/root/testdata/sf0.01"],
        capture_output=True, text=True, timeout=900, cwd=ROOT, check=True)
    return json.loads(out.stdout)


def shuffled(stage_list):
    return [s for s in stage_list if s["shuffle_records"] >= 500]


@pytest.mark.parametrize("phase", ["route_measures", "ranked_median", "route_profile", "user_measures", "first_seen",
                                   "bucket_measures", "source_destination"])
def test_hot_route_is_spread(stages, phase):
    assert shuffled(stages[phase])
    for s in shuffled(stages[phase]):
        assert s["max_task_share"] < 0.25, s     # 16 partitions: 0.0625 is even


def test_control_shows_the_skew(stages):
    # a per-route window sends every row of the hot route to one task
    assert max(s["max_task_share"] for s in shuffled(stages["control_per_route_window"])) >= 0.33
