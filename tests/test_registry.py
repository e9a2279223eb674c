"""Registry: versions, review queue, idempotence, rollback."""

import pytest

from tablecare.plans.registry import (
    Registry,
    RegistryError,
    as_of,
    log_summary,
    suite_diff,
    undecided,
    version_clashes,
    version_rows,
)
from tablecare.spec import Fix, between, not_null, unique

SUITE = [not_null("id"), unique("id"), between("x", 0, 10)]
EXTRA = between("x", 0, 5)
FIX = Fix("fill_null", "x", {"value": 1}, "x is filled")


@pytest.fixture()
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path))


def test_starts_empty_at_version_zero(registry):
    assert registry.version("rule") == 0 == registry.version("fix")
    assert registry.active_rules() == [] and registry.active_fixes() == []
    assert registry.candidates(None).isEmpty() and registry.log().isEmpty()
    with pytest.raises(RegistryError):
        registry.versions("model")


def test_whole_life(spark, registry):
    assert registry.seed([*SUITE, SUITE[0]]) == 1
    assert registry.active_rules() == SUITE
    with pytest.raises(RegistryError):
        registry.seed(SUITE)

    rule_id, fix_id, weak_id, bad_id = registry.add_candidates(
        "run-1", 1,
        [(EXTRA, SUITE[2].rule_id, True, "ok"), (FIX, SUITE[2].rule_id, True, "ok"),
         (Fix("trim", "s"), SUITE[0].rule_id, False, "changed nothing"), (SUITE[2], SUITE[2].rule_id, True, "ok")],
    )
    assert {r["candidate_id"] for r in registry.candidates().collect()} == {rule_id, fix_id, weak_id, bad_id}

    # Promoted once, however often it is asked for.
    assert registry.promote(rule_id, "user:ann") == ["approved"]
    assert registry.promote(rule_id, "user:ann") == ["approved"]
    assert registry.version("rule") == 2 and registry.active_rules() == [*SUITE, EXTRA]
    assert registry.promote([fix_id], "system:auto") == ["auto_promoted"]
    assert registry.promote([fix_id], "system:auto") == ["auto_promoted"]
    assert registry.version("fix") == 1 and registry.active_fixes() == [FIX]
    assert registry.active_fixes()[0].description == "x is filled"
    assert registry.log().count() == 2

    # What did not pass its gates needs force; what is in force already makes no new version.
    with pytest.raises(RegistryError):
        registry.promote(weak_id, "user:ann")
    assert registry.promote(bad_id, "user:ann") == ["approved"]
    assert registry.version("rule") == 2

    assert registry.reject(weak_id, "user:bob", "no use") == "rejected"
    assert registry.reject(weak_id, "user:bob") == "rejected"
    with pytest.raises(RegistryError):
        registry.reject(rule_id, "user:bob")
    with pytest.raises(RegistryError):
        registry.promote(weak_id, "user:ann", force=True)
    with pytest.raises(RegistryError):
        registry.promote("nobody", "user:ann")
    assert registry.candidates().isEmpty()
    assert undecided(registry.candidates(None), registry.log()).isEmpty()

    # Going back is a new version as well.
    assert registry.rollback("rule", 1, "user:ann") == 3
    assert registry.active_rules() == SUITE
    assert registry.rollback("fix", 0, "user:ann") == 2
    assert registry.active_fixes() == [] and registry.version("fix") == 2
    with pytest.raises(RegistryError):
        registry.rollback("rule", 9, "user:ann")

    versions = registry.versions("rule")
    assert [r["item_id"] for r in as_of(versions, version=2).orderBy("ord").collect()][-1] == EXTRA.rule_id
    early = versions.filter("version = 1").first()["recorded_at"]
    assert as_of(versions, at=early).count() == 3
    assert {(r["item_id"], r["change"]) for r in suite_diff(versions, 2, 3).collect()} == {(EXTRA.rule_id, "removed")}
    assert version_rows(versions, 3).count() == 3
    counted = {(r["artifact"], r["action"]): r["decisions"] for r in log_summary(registry.log()).collect()}
    assert counted == {
        ("rule", "approved"): 2, ("fix", "auto_promoted"): 1, ("fix", "rejected"): 1,
        ("rule", "rolled_back"): 1, ("fix", "rolled_back"): 1,
    }


def test_two_writers_of_one_version_are_found(spark, tmp_path):
    first, second = Registry(spark, str(tmp_path)), Registry(spark, str(tmp_path))
    first.seed([not_null("a")])
    (candidate,) = first.add_candidates("run", 1, [(not_null("b"), "source", True, "")])
    (other,) = first.add_candidates("run", 1, [(not_null("c"), "source", True, "")])
    second.version = lambda artifact: 1  # has read the version before the first one wrote
    first.promote(candidate, "user:ann")
    with pytest.raises(RegistryError, match="another writer"):
        second.promote(other, "user:ben")
    (clash,) = version_clashes(first.versions("rule")).collect()
    assert (clash.version, clash.writers, clash.actor) == (2, 2, "user:ann")
    assert first.candidates("pending").count() == 1  # the refused promotion left no event
    assert version_clashes(first.versions("fix")).isEmpty()


def test_versions_are_compared_as_sets(spark):
    rows = [(1, 0, "a", None, "x"), (1, 1, "a", None, "x"), (1, 2, "b", "k", None), (1, -1, "h", "k", "x"), (3, 0, "z", "k", "x")]
    rows += [(2, 0, "a", None, "x"), (2, 0, "c", "k", "x"), (2, 1, "c", "k", "x"), (2, None, "n", "k", "x"), (None, 0, "v", "k", "x")]
    versions = spark.createDataFrame(rows, "version bigint, ord int, item_id string, kind string, column string")
    versions = versions.selectExpr("*", "'{}' AS params")
    got = suite_diff(versions, 1, 2)
    assert got.columns == ["item_id", "kind", "column", "params", "change"]
    assert sorted((r["item_id"], r["change"]) for r in got.collect()) == [("b", "removed"), ("c", "added")]
    assert suite_diff(versions, 1, 1).isEmpty()
    assert {(r["item_id"], r["change"]) for r in suite_diff(versions, 9, 1).collect()} == {("a", "added"), ("b", "added")}
