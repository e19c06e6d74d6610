"""Names at places in source lines, and generic signatures as text."""

import pytest
from javac import compiled

from codeloom.functions.signature import readable
from codeloom.functions.source import count_arguments, masked, name_at, use_at
from codeloom.sources import classfile


@pytest.mark.parametrize(
    ("line", "marked", "found"),
    [
        ("Foo x = new Foo(1, \"a, b\");", "new Foo", ("Foo", None, "constructor", 2)),
        ("Foo x = new Foo();", "Foo", ("Foo", None, "none", None)),
        ("this.items.add(f(1, 2), g[3, 4], (a, b));", "add", ("add", "this.items", "call", 3)),
        ("return other.state;", "state", ("state", "other", "member", None)),
        ("call(list, x < y);", "call", ("call", None, "call", None)),
        ("call(a, { b, c -> d < e }, ',', /* , */ \"\\\",\");", "call", ("call", None, "call", 4)),
        ("call(a,);", "call", ("call", None, "call", None)),
        ("call(1, // , 2", "call", ("call", None, "call", 2)),
        ("x.y().z", "z", ("z", None, "member", None)),
        ("größe + 1", "größe", ("größe", None, "none", None)),
        ("new  pkg.Foo(1)", "Foo", ("Foo", "pkg", "call", 1)),
    ],
)
def test_uses(line, marked, found):
    at = line.index(marked) + len(marked)
    use = use_at(line, at, "3);" if line.endswith("// , 2") else "")
    assert use["identifier"] == found[0] and (use["context"], use["arguments"]) == found[2:]
    assert use["receiver"] == found[1]


def test_edges():
    assert name_at("", 1) is None and name_at("   ", 2) is None and name_at("1x", 1) is None and name_at("ab", 99) == (0, 2) and name_at("ab c", 3) == (0, 2) and name_at("ab", 0) is None
    assert use_at("", 4) is None and count_arguments("(") is None and count_arguments("()") == 0 and count_arguments("( a )") == 1 and count_arguments("(a]") is None and count_arguments("(,)") is None
    text = 'a("x\\"y", \'"\', """b " c""") // d\n/* e */ f'
    assert len(masked(text)) == len(text) and not {"x", "y", "b", "d", "e"} & set(masked(text)) and masked(text).endswith(" f")
    assert all(len(masked(t)) == len(t) for t in ('"', "'", '"""', '"""a', "/*", "//", '"a\\', "''", '""', '"""""'))


@pytest.mark.parametrize(
    ("signature", "text"),
    [
        ("Ljava/util/List<Ljava/lang/String;>;", "java.util.List<java.lang.String>"),
        ("<T:Ljava/lang/Object;>(TT;I[[J)V", "<T> void (T, int, long[][])"),
        ("<T::Ljava/lang/Comparable<-TT;>;E:Ljava/lang/Exception;:Ljava/io/Closeable;>(Ljava/util/Map<*+TT;>;)TT;^TE;^Ljava/io/IOException;", "<T extends java.lang.Comparable<? super T>, E extends java.lang.Exception & java.io.Closeable> T (java.util.Map<?, ? extends T>) throws E, java.io.IOException"),
        ("<K:Ljava/lang/Object;>Lp/Base<TK;>.Inner<TK;>;Lp/I;", "<K> p.Base<K>.Inner<K>, p.I"),
        (None, None), ("", ""), ("broken", "broken"), ("Lp/A", "Lp/A"), ("II", "int, int"),
    ],
)
def test_signatures(signature, text):
    assert readable(signature) == text


def test_evidence_of_class_files(spark, tmp_path):
    source = """package p; import java.io.*; public abstract class Api<T extends Number> { public static final double ZERO = -0.0; public static final int N = 7; static final String S = "s"; protected static final class In {}
        public java.util.List<T> all() throws IOException, EOFException { return null; } static { System.gc(); } }"""
    rows = {(r.class_name, r.member, r.field): r.value for r in classfile.jvm_api(classfile.read_class_files(spark, compiled(tmp_path, {"p/Api.java": source}))).collect()}
    assert rows["p.Api", "", "flags"] == "abstract public" and rows["p.Api$In", "", "flags"] == "final protected static" and readable(rows["p.Api", "", "signature"]) == "<T extends java.lang.Number> java.lang.Object"
    method = "METHOD all ()Ljava/util/List;"
    assert rows["p.Api", method, "exceptions"] == "java.io.EOFException,java.io.IOException" and readable(rows["p.Api", method, "signature"]) == "java.util.List<T> ()"
    assert rows["p.Api", "FIELD ZERO D", "constant"].startswith("-0.0 ") and rows["p.Api", "FIELD N I", "constant"] == "7" and rows["p.Api", "FIELD S Ljava/lang/String;", "constant"] == "s"
    assert not [m for _, m, _ in rows if "clinit" in m]
