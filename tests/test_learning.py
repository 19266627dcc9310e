"""Learning libraries, versions in time and running totals on small cases with known results."""

import math

import numpy as np
import pytest

from ridgeline.operators import learning
from ridgeline.operators.learning import Rules, Template, attempt

SCHEMA = "identity long, rank int, ord long, id long, content string, v array<double>, box array<double>"


def at(angle):
    return [math.cos(angle), math.sin(angle)]


def template(k, angle, content="", box=(0, 0, 10, 10), kept=False):
    return Template(k, content, np.array(at(angle)), np.array(box, float), kept)


def test_an_attempt_names_every_reason_and_moves_what_matched():
    rules = Rules(unlock=0.6, learn=0.9, most_common=0.5, least_pixels=20, size=3)
    library = [template(1, 0.0, "a", kept=True), template(2, 2.0, "b", kept=True)]
    score, matched, accepted, learned, *_ = attempt(library, template(3, 1.9, "b"), rules)
    assert (matched, accepted, learned) == (2, True, False) and 0.9 < score < 1 and [t.id for t in library] == [2, 1]
    got = attempt(library, template(4, 0.05, "a"), rules)
    assert got[5] == ["duplicate_template_content", "no_high_score_low_overlap_match"] and got[8] == 1 and [t.id for t in library] == [1, 2]
    got = attempt(library, template(5, 0.05, "c", (5, 5, 10, 10)), rules)
    assert got[2:6] == (True, True, None, ["accepted"]) and got[7:] == (0.25, 2, 3) and [t.id for t in library] == [5, 1, 2]
    got = attempt(library, template(6, 2.05, "d", (5, 5, 10, 10)), rules)
    assert got[2:5] == (True, True, 5) and [t.id for t in library] == [6, 2, 1]
    library[0].protected = True
    assert attempt(library, template(7, 0.05, "e", (5, 5, 10, 10)), rules)[5] == ["template_library_full_and_all_templates_protected"]
    assert attempt(library, template(8, 4.0, "f"), rules)[1:6] == (6, False, False, None, ["unlock_failed"])
    assert attempt([], template(9, 0.0), rules) == (0.0, None, False, False, None, ["unlock_failed"], 0, None, 0, 0)
    assert attempt([template(1, 0.0)], template(2, 0.0, "new", (50, 50, 10, 10)), rules)[5] == ["no_high_score_low_overlap_match"]


@pytest.fixture(scope="module")
def world(spark):
    rules = Rules(unlock=0.6, learn=0.8, most_common=0.9, least_pixels=1, size=2)
    low = [5.0, 5.0, 10.0, 10.0]
    seeds = [(1, 1, None, 101, "s", at(0.0), [0.0, 0.0, 10.0, 10.0]), (2, 1, None, 201, "s", at(3.0), [0.0, 0.0, 10.0, 10.0])]
    queries = [(1, None, 10, 11, "q1", at(0.2), low), (2, None, 20, 21, "q2", at(2.9), low), (1, None, 30, 12, "q3", at(0.3), low), (3, None, 40, 31, "q", at(1.0), low), (None, None, 50, 1, "q", at(1.0), low), (1, None, None, 2, "q", at(1.0), low), (1, None, 60, 3, "q", None, low)]
    return spark.createDataFrame(seeds, SCHEMA), spark.createDataFrame(queries, SCHEMA), rules


def test_impostors_meet_the_libraries_of_their_time(spark, world):
    seeds, queries, rules = world
    log, every = learning.attempts(seeds, queries, rules)
    rows = {r["query"]: r for r in log.collect()}
    assert rows.keys() == {11, 12, 21, 31}
    assert rows[11]["learned"] and rows[21]["learned"] and rows[31]["reasons"] == ["unlock_failed"]
    assert [rows[q]["update_counter"] for q in (11, 21, 12, 31)] == [2, 4, 4 + rows[12]["updates"], 4 + rows[12]["updates"]]
    got = {(r["query"], r["identity"]): (r["genuine"], r["matched"]) for r in every.collect()}
    assert got[11, 2] == (False, 201) and got[21, 1] == (False, 11) and got[12, 2] == (False, 21) and got[31, 1][1] in (11, 12, 101) and got[31, 3] == (True, None)
    assert (11, 3) not in got and len(got) == 9
    done = learning.learning_summary(seeds, log, rules).head()
    assert (done["initial_template_count"], done["num_queries_processed"], done["max_active_templates"]) == (2, 4, 2)
    none = learning.learning_summary(seeds.limit(0), learning.genuine_log(seeds, queries.limit(0), rules), rules).head()
    assert none["num_queries_processed"] == 0 and none["update_counter"] == 0


def test_running_totals_cross_spans(spark):
    rows = [(k, v) for k, v in enumerate([3, 0, 5, 1, 1, 4, 2, 8])] + [(7, 1)]
    got = learning.running_total(spark.createDataFrame(rows, "at long, n int"), "at", "n", 3, "total").collect()
    assert sorted((r["at"], r["n"], r["total"]) for r in got) == sorted((k, v, sum(w for j, w in rows if j <= k)) for k, v in rows)
