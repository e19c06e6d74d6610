"""Beans and points out of class files; generations compared by their own names; constants followed through methods."""

import random

import pytest
from javac import compiled

from codeloom.operators import beans, compare
from codeloom.plans.snapshot import Snapshot
from codeloom.runtime import stored
from codeloom.sources import classfile

RUN = "@java.lang.annotation.Retention(java.lang.annotation.RetentionPolicy.RUNTIME) "
STUBS = {
    "jakarta.inject": ("Inject", "Qualifier", "Scope", "Singleton", "Named:String value() default \"\";"), "jakarta.enterprise.context": ("NormalScope", "ApplicationScoped", "Dependent", "RequestScoped"),
    "jakarta.enterprise.inject": ("Stereotype", "Produces", "Specializes", "Alternative"), "jakarta.annotation": ("Priority:int value();",), "jakarta.interceptor": ("Interceptor",),
    "io.quarkus.arc": ("DefaultBean",), "io.quarkus.arc.profile": ("IfBuildProfile:String value();", "UnlessBuildProfile:String value();"),
}
SOURCES = {f"{p.replace('.', '/')}/{n.partition(':')[0]}.java": f"package {p}; {RUN} public @interface {n.partition(':')[0]} {{ {n.partition(':')[2]} }}" for p, names in STUBS.items() for n in names}
SOURCES["demo/All.java"] = f"""package demo; import jakarta.inject.*; import jakarta.enterprise.context.*; import jakarta.enterprise.inject.*; import jakarta.annotation.Priority; import io.quarkus.arc.*; import io.quarkus.arc.profile.*;
    {RUN} @Qualifier @interface Fast {{}} {RUN} @Fast @interface Faster {{}} {RUN} @Scope @interface Tenant {{}} {RUN} @Stereotype @RequestScoped @interface Action {{}} {RUN} @Stereotype @Action @Alternative @Priority(7) @interface Deep {{}}
    interface Root {{}} interface Mid extends Root {{}} class Plain {{}}
    @ApplicationScoped class A implements Mid {{ @Inject Root root; @Inject @Fast Mid fast; @Produces @Named("n") @Priority(3) String made(@Fast Root r, int k) {{ return ""; }} @Produces @DefaultBean A[] many; @Inject A(@Named Root x, Mid y) {{}} @Inject void set(@Faster Mid m) {{}} }}
    @Fast @Dependent class B extends Plain implements Mid {{}} @Faster @Tenant @IfBuildProfile("dev") class C implements Mid {{}} @Action class D {{}} @Deep class E {{}} @Deep @Singleton @UnlessBuildProfile("p") @Named class F {{}}
    @Specializes @Dependent class G extends B {{}} @Specializes @Named("g") @Dependent class H extends G {{}} @Dependent abstract class Not {{}} class Nothing {{}} @jakarta.interceptor.Interceptor class I {{}} @Dependent @Alternative @Priority(2) class J implements Root {{}}"""
SOURCES["demo/Conf.java"] = """package demo; class Conf { static final String KEY = "k.field"; static String LATE = "no"; static class Env implements org.springframework.core.env.Environment { public String getProperty(String k) { return k; } }
    void plain() { System.getProperty("k.plain"); } void local() { String a = "k.local"; int x = 3; String b = a; System.getProperty(b); } void field() { System.getProperty(KEY); } void late() { System.getProperty(LATE); }
    void joined(String s) { System.getProperty("k." + s); } void branch(boolean c) { String a = "k.one"; if (c) a = "k.two"; System.getProperty(a); } void loop(int n) { String a = "k.loop"; for (int i = 0; i < n; i++) { System.getProperty(a); a = "k.next"; } }
    void before(boolean c) { System.getProperty("k.before", c ? "x" : "y"); } void below(Env e) { e.getProperty("k.env"); } void caught() { String a = "k.try"; try { a.length(); } catch (RuntimeException e) { System.getProperty(a); } }
    void res() { getClass().getResource("near.txt"); Conf.class.getResource("/top.txt"); java.util.ResourceBundle.getBundle("i18n.msg"); Env.class.getClassLoader().getResource("a/b.txt"); java.util.List.class.getResource("list.txt"); } void twice() { String a; String b = a = "k.twice"; System.getProperty(b); System.getProperty(a); } }"""  # fmt: skip
SOURCES["org/springframework/core/env/Environment.java"] = "package org.springframework.core.env; public interface Environment { String getProperty(String key); }"


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    return stored(classfile.read_class_files(spark, compiled(tmp_path_factory.mktemp("beans"), SOURCES)))


@pytest.fixture(scope="module")
def found(parsed):
    own, points = beans.discover(parsed)
    return stored(own), stored(points)


def test_beans(found):
    rows = {(r.class_name.removeprefix("demo."), r.member_name): r for r in found[0].collect()}
    assert set(rows) == {*((c, None) for c in "ABCDEFGHIJ"), ("A", "made"), ("A", "many")}
    facts = {k: (r.kind, r.scope, set(r.qualifiers), r.is_alternative, r.is_default, r.priority) for k, r in rows.items()}
    both = {"@Default", "@Any"}
    assert facts["A", None] == ("CLASS", "@ApplicationScoped", both, False, False, None)
    assert facts["A", "made"] == ("PRODUCER_METHOD", "@Dependent", {'@Named("n")', *both}, False, False, 3) and facts["A", "many"] == ("PRODUCER_FIELD", "@Dependent", both, False, True, None)
    assert facts["B", None][2] == {"@Fast", "@Any"} and facts["C", None][1:3] == ("@Tenant", {"@Faster", "@Any"})
    assert facts["D", None][1] == "@RequestScoped" and facts["E", None][1:] == ("@RequestScoped", both, True, False, 7) and facts["F", None][1:] == ("@Singleton", {"@Named", *both}, True, False, 7)
    assert facts["G", None][2] == {"@Fast", "@Any"} and facts["H", None][2] == {"@Fast", '@Named("g")', "@Any"} and facts["I", None][0] == "INTERCEPTOR" and facts["J", None][3:] == (True, False, 2)
    assert set(rows["G", None].types) == {"demo.G", "demo.B", "demo.Plain", "demo.Mid", "demo.Root"} and rows["A", "made"].types == ["java.lang.String"] and rows["A", "many"].types == ["[Ldemo.A;"]
    assert rows["H", None].specializes_id == rows["G", None].id and rows["G", None].specializes_id == rows["B", None].id
    assert rows["C", None].profiles == ["dev"] and rows["F", None].profiles == ["!p"] and rows["E", None].stereotypes == ["@Deep"]


def test_points(found):
    names = {r.id: (r.class_name.removeprefix("demo."), r.member_name) for r in found[0].collect()}
    got = {(names[r.bean_id], r.kind, r.member_name, r.position, r.target_type.rpartition(".")[2], *r.qualifiers) for r in found[1].collect()}
    a, made = ("A", None), ("A", "made")
    assert got == {
        (a, "FIELD", "root", None, "Root", "@Default"), (a, "FIELD", "fast", None, "Mid", "@Fast"), (made, "METHOD_PARAM", "made", 0, "Root", "@Fast"), (made, "METHOD_PARAM", "made", 1, "int", "@Default"),
        (a, "CONSTRUCTOR_PARAM", "<init>", 0, "Root", "@Named"), (a, "CONSTRUCTOR_PARAM", "<init>", 1, "Mid", "@Default"), (a, "METHOD_PARAM", "set", 0, "Mid", "@Faster"),
    }


def test_resolution(found):
    names = {r.id: r.class_name.removeprefix("demo.") for r in found[0].collect()}
    points = {r.id: (r.member_name, r.position) for r in found[1].collect()}
    got = {points[r.point_id]: (names.get(r.bean_id), r.status) for r in beans.typed_resolution(found[1], found[0]).collect()}
    # B and G are replaced by H; J is the alternative of highest priority among those of the default qualifier
    assert got["fast", None] == ("H", "RESOLVED") and got["made", 0] == ("H", "RESOLVED") and got["root", None] == ("J", "RESOLVED")
    assert got["<init>", 1] == ("A", "RESOLVED") and got["set", 0] == ("C", "RESOLVED") and got["<init>", 0][1] == got["made", 1][1] == "UNSATISFIED"


def test_matches_equal_brute_force(spark):
    dice = random.Random(2)
    some = lambda of, k: sorted(dice.sample(of, dice.randrange(1, k)))
    own = [(i, some("TUVW", 4), some(["a", "b", "c", "@Any"], 4)) for i in range(80)]
    points = [(i, dice.choice("TUVWX"), some(["a", "b", "c", "d", "@Any"], 4)) for i in range(60)] + [(99, "T", ["@Any"])]
    got = {tuple(r) for r in beans.matching_beans(spark.createDataFrame(points, "id long, target_type string, qualifiers array<string>"), spark.createDataFrame(own, "id long, types array<string>, qualifiers array<string>")).collect()}
    assert got == {(p, b) for p, t, q in points for b, types, has in own if t in types and {*q} - {"@Any"} <= {*has}} and len(got) > 200


def test_constants(parsed):
    rows = {(r.method, r.usage, r.value) for r in classfile.programmatic_usages(parsed).where("class_name = 'demo.Conf'").collect()}
    assert {(m, v) for m, u, v in rows if u == "config_key"} == {("plain", "k.plain"), ("local", "k.local"), ("field", "k.field"), ("below", "k.env"), ("twice", "k.twice")}
    assert {m for m, u, _ in rows if u == "dynamic_config_key"} == {"late", "joined", "branch", "loop", "caught", "before"}
    assert {v for _, u, v in rows if u == "resource"} == {"demo/near.txt", "top.txt", "a/b.txt", "java/util/list.txt"} and {v for _, u, v in rows if u == "resource_bundle"} == {"i18n/msg.properties"}


def test_generations_by_their_own_names(spark):
    """A class went, another took its id, and a third changed its id."""
    kind = "id long, class_name string, lifecycle string, origin string"
    rows = lambda *names: spark.createDataFrame([(i, n, "current", "source") for i, n in names] + [(99, "old.X", "historical", "source")], kind)
    deps = lambda *pairs: spark.createDataFrame([(a, b, "CALLS", n) for a, b, n in pairs], "from_class_id long, to_class_id long, kind string, occurrence_count long")
    own = lambda *ids: spark.createDataFrame([(k, i, "MANAGED", "m") for k, i in ids], "id long, class_id long, kind string, member_name string")
    s = Snapshot.of(spark, {
        "baseline_classes": rows((1, "a.Gone"), (2, "a.Kept"), (3, "a.Moved")), "classes": rows((1, "a.New"), (2, "a.Kept"), (4, "a.Moved")),
        "baseline_dependencies": deps((1, 2, 5), (3, 2, 1), (99, 2, 1)), "dependencies": deps((1, 2, 5), (4, 2, 2), (99, 2, 7)), "baseline_beans": own((10, 1), (11, 3)), "beans": own((10, 1), (12, 4)),
    })
    assert {tuple(r) for r in compare.compare_dependencies(s).collect()} == {("a.Gone -> a.Kept [CALLS]", "removed", 5, None), ("a.New -> a.Kept [CALLS]", "added", None, 5), ("a.Moved -> a.Kept [CALLS]", "modified", 1, 2)}
    assert {tuple(r) for r in compare.compare_beans(s).collect()} == {("a.Gone [MANAGED] m", "removed"), ("a.New [MANAGED] m", "added")}
    points = lambda *of: spark.createDataFrame([(b, f, "T", "@Default", st) for b, f, st in of], "bean_id long, field_name string, target_type string, qualifier string, status string")
    was = compare.injection_values(points((10, "f", "RESOLVED"), (11, "g", "RESOLVED")), s.baseline_beans, s.baseline_classes)
    now = compare.injection_values(points((10, "f", "RESOLVED"), (12, "g", "AMBIGUOUS")), s.beans, s.classes)
    assert {(r.injection.partition(" ")[0], r.change, r.was, r.is_now) for r in compare.compare_injections(was, now).collect()} == {("a.Gone#f", "removed", "RESOLVED:", None), ("a.New#f", "added", None, "RESOLVED:"), ("a.Moved#g", "resolution_changed", "RESOLVED:", "AMBIGUOUS:")}
