"""Chains of forwarding calls, closed by doubling, and usages seen through them."""

import pytest

from codeloom.operators import forwarding as f
from codeloom.plans.snapshot import Snapshot


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 40])
def test_chains_are_closed_up_to_32(spark, n):
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (101, 100), (0, 2)], "src long, dst long")
    got = {(r.src, r.dst): r.steps for r in f.forwarding_chains(edges).collect()}
    assert got[100, 101] == got[101, 100] == 1 and (100, 100) not in got
    for a in range(n):
        for b in range(a + 1, n + 1):
            least = b - a - (a == 0 and b >= 2)
            assert got.get((a, b)) == (least if least <= 32 else None)


def test_rules(spark):
    """A default method, the overload for Java that calls it, a facade, a companion, a bridge, and what is no forwarder."""
    calls = [
        (1, "use", "()V", 1, "f", "()V", "static", 1), (1, "f", "()V", 1, "f$default", "(IILjava/lang/Object;)V", "static", 1), (1, "f$default", "(IILjava/lang/Object;)V", 1, "f", "(I)V", "static", 1),
        (2, "g", "(I)V", 3, "g", "(I)V", "static", 1), (4, "c", "()V", 5, "c", "()V", "virtual", 1), (1, "b", "(Ljava/lang/Object;)V", 1, "b", "(Ljava/lang/String;)V", "virtual", 1),
        (1, "twice", "()V", 1, "twice", "(I)V", "static", 2), (1, "mask$default", "(IIILjava/lang/Object;)V", 1, "mask", "(I)V", "static", 1),
    ]
    semantics = [(1, "FUNCTION", "f", "(I)V", True, 1), (1, "FUNCTION", "b", "(Ljava/lang/String;)V", False, 1), (1, "FUNCTION", "use", "()V", False, 0), (1, "FUNCTION", "twice", "(I)V", False, 1), (1, "FUNCTION", "mask", "(I)V", True, 1)]
    semantics += [(2, "MULTIFILE_FACADE", None, None, False, None), (3, "MULTIFILE_PART", None, None, False, None), (3, "FUNCTION", "g", "(I)V", False, 1), (4, "CLASS", None, None, False, None), (5, "COMPANION_OBJECT", None, None, False, None), (5, "FUNCTION", "c", "()V", False, 0)]
    s = Snapshot.of(spark, {
        "classes": spark.createDataFrame([(1, "p.A"), (2, "p.B"), (3, "p.B__Part"), (4, "p.C"), (5, "p.C$Companion")], "id long, class_name string"),
        "method_calls": spark.createDataFrame(calls, "caller_class_id long, caller_method string, caller_descriptor string, target_class_id long, target_method string, target_descriptor string, invocation_kind string, occurrence_count long"),
        "class_members": spark.createDataFrame([(1, "METHOD", "f", "()V", "kotlin.jvm.JvmOverloads"), (1, "METHOD", "twice", "()V", "@JvmOverloads")], "class_id long, kind string, name string, descriptor string, annotations string"),
        "kotlin_semantics": spark.createDataFrame([(*r, False, False) for r in semantics], "class_id long, kind string, jvm_name string, descriptor string, has_defaults boolean, value_parameters int, is_suspend boolean, is_extension boolean"),
    })
    got = {(r.caller_method, r.caller_descriptor): r.forwards for r in f.forwarding_calls(s).collect()}
    assert got == {
        ("use", "()V"): False, ("f", "()V"): True, ("f$default", "(IILjava/lang/Object;)V"): True, ("g", "(I)V"): True, ("c", "()V"): True, ("b", "(Ljava/lang/Object;)V"): True, ("twice", "()V"): False, ("mask$default", "(IIILjava/lang/Object;)V"): False,
    }
    seen = {(r.target, r.through, r.steps) for r in f.usages_through_forwarders(s).rows.where("caller = '1#use#()V'").collect()}
    assert seen == {("1#f#()V", "", 0), ("1#f$default#(IILjava/lang/Object;)V", "1#f#()V", 1), ("1#f#(I)V", "1#f#()V", 2)}
