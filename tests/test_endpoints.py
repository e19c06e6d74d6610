"""Composed and inherited routes out of class files."""

import pytest
from javac import compiled

from codeloom.operators import endpoints, search
from codeloom.plans.parsed import snapshot_of
from codeloom.runtime import stored
from codeloom.sources import classfile

RUN = "@java.lang.annotation.Retention(java.lang.annotation.RetentionPolicy.RUNTIME) "
WEB = "org/springframework/web/bind/annotation"
SOURCES = {
    f"{WEB}/RequestMethod.java": "package org.springframework.web.bind.annotation; public enum RequestMethod { GET, POST, PUT, DELETE }",
    f"{WEB}/RequestMapping.java": f"package org.springframework.web.bind.annotation; {RUN} public @interface RequestMapping {{ String[] value() default {{}}; String[] path() default {{}}; RequestMethod[] method() default {{}}; }}",
    f"{WEB}/GetMapping.java": f"package org.springframework.web.bind.annotation; {RUN} public @interface GetMapping {{ String[] value() default {{}}; String[] path() default {{}}; }}",
    f"{WEB}/PostMapping.java": f"package org.springframework.web.bind.annotation; {RUN} public @interface PostMapping {{ String[] value() default {{}}; String[] path() default {{}}; }}",
    "org/springframework/core/annotation/AliasFor.java": f"package org.springframework.core.annotation; import java.lang.annotation.*; {RUN} public @interface AliasFor {{ Class<? extends Annotation> annotation() default Annotation.class; String attribute() default \"\"; String value() default \"\"; }}",
    **{f"jakarta/ws/rs/{n}.java": f"package jakarta.ws.rs; {RUN} public @interface {n} {{ {b} }}" for n, b in (("Path", "String value();"), ("HttpMethod", "String value();"), ("PathParam", "String value();"))},
    **{f"jakarta/ws/rs/{n}.java": f"package jakarta.ws.rs; @HttpMethod(\"{n}\") {RUN} public @interface {n} {{}}" for n in ("GET", "POST")},
    "demo/Marks.java": f"""package demo; import org.springframework.core.annotation.AliasFor; import org.springframework.web.bind.annotation.*;
        {RUN} @RequestMapping(method = RequestMethod.PUT) @interface Put {{ @AliasFor(annotation = RequestMapping.class, attribute = "path") String[] at() default {{}}; }}
        {RUN} @Put @interface Deep {{ @AliasFor(annotation = Put.class, attribute = "at") String[] where() default {{"/deep"}}; }}
        {RUN} @Put(at = "/fixed") @interface Fixed {{}}
        {RUN} @GetMapping @interface Mirror {{ @AliasFor("path") String[] value() default {{}}; @AliasFor("value") String[] path() default {{}}; }}
        {RUN} @GetMapping @interface Through {{ @AliasFor("path") String[] value() default {{}}; @AliasFor(annotation = GetMapping.class) String[] path() default {{}}; }}
        {RUN} @RequestMapping @interface Two {{ @AliasFor(annotation = RequestMapping.class, attribute = "path") String[] x() default {{}}; @AliasFor(annotation = RequestMapping.class, attribute = "path") String[] y() default {{}}; }}
        {RUN} @Loop @RequestMapping("/loop") @interface Loop {{}}
        {RUN} @jakarta.ws.rs.HttpMethod("PURGE") @interface Purge {{}}""",
    "demo/Ctl.java": """package demo; import org.springframework.web.bind.annotation.*;
        @RequestMapping("/api") class Ctl { @Put(at = "/p") public void p() {} @Deep public void d() {} @Deep(where = "/w") public void w() {} @Fixed public void f() {} @Mirror("/lost") public void mirror() {}
        @Through("/t") public void through() {} @Two(x = "/1", y = "/2") public void two() {} @Two(x = "/1") public void one() {} @Loop public void loop() {} @GetMapping({"/g", "/h"}) void g() {}
        @RequestMapping(value = "/a", path = "/b") public void clash() {} @RequestMapping public void any() {} }""",
    "demo/Api.java": """package demo; import org.springframework.web.bind.annotation.*;
        interface Api { @GetMapping("/list") String list(); @PostMapping("/save") void save(String s); @GetMapping("/def") default void def() {} }
        class Impl implements Api { public String list() { return ""; } public void save(String s) {} public void other() {} }
        class Sub extends Impl { public String list() { return "x"; } }
        interface A1 { @GetMapping("/a") void m(); } interface A2 { @GetMapping("/b") void m(); } class Conf implements A1, A2 { public void m() {} }
        interface D1 extends Api {} interface D2 extends Api {} class Diamond implements D1, D2 { public String list() { return ""; } public void save(String s) {} }
        interface Gen<T> { @PostMapping("/gen") void put(T t); } class GenImpl implements Gen<String> { public void put(String s) {} }
        class Gone {} class Lost extends Gone implements Api { public String list() { return ""; } public void save(String s) {} @GetMapping("/own") public void own() {} }
        @RequestMapping("/base") class Based implements Api { public String list() { return ""; } public void save(String s) {} }
        class Below extends Based { @Two(x = "/1", y = "/2") public void save(String s) {} }""",
    "demo/Rest.java": """package demo; import jakarta.ws.rs.*;
        @Path("/r") class R { @GET @Path("x") public String x() { return ""; } @Purge public void c() {} @Path("sub") public Object sub() { return null; } @GET void hidden() {} public void none() {} }
        interface J { @GET @Path("/j") String j(); } class JImpl implements J { public String j() { return ""; } }
        interface J2 extends J { @POST @Path("/j2") String j(); } class JBoth implements J, J2 { public String j() { return ""; } }
        interface K { @GET @Path("/k") String j(); } class JConf implements J, K { public String j() { return ""; } }
        class Base { @POST public void k() {} } class Derived extends Base { public void k() {} } class Own extends Base { @GET public void k() {} }
        class Param implements J3 { public String p(@PathParam("q") String a) { return ""; } } interface J3 { @GET @Path("/p") String p(String a); }""",
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = compiled(tmp_path_factory.mktemp("routes"), SOURCES, ["demo/Gone"])
    s = snapshot_of(stored(classfile.read_class_files(spark, root)), module="web")
    for name in ("classes", "class_interfaces", "class_members", "method_calls", "annotation_uses", "annotation_elements", "annotation_metas"):
        s._made[name] = stored(s[name])
    return s


@pytest.fixture(scope="module")
def found(index):
    return {(r.class_name.removeprefix("demo."), r.name, r.framework): r for r in endpoints.declared_routes(index).collect()}


def said(found, *key):
    r = found.get(key)
    return r and (list(r.verbs), list(r.bases), list(r.paths))


def test_composed_routes(found):
    own = {m: said(found, "Ctl", m, "spring") for m in ("p", "d", "w", "f", "mirror", "through", "two", "one", "loop", "g", "clash", "any")}
    base = ["/api"]
    assert own == {
        "p": (["PUT"], base, ["/p"]), "d": (["PUT"], base, ["/deep"]), "w": (["PUT"], base, ["/w"]), "f": (["PUT"], base, ["/fixed"]), "mirror": (["GET"], base, [""]), "through": None, "two": None,
        "one": (["ANY"], base, ["/1"]), "loop": (["ANY"], base, ["/loop"]), "g": (["GET"], base, ["/g", "/h"]), "clash": None, "any": (["ANY"], base, [""]),
    }
    assert found["Ctl", "d", "spring"].evidence == ["demo.Deep", "demo.Put", endpoints.REQUEST]


def test_inherited_routes(found):
    none = [""]
    assert said(found, "Impl", "list", "spring") == (["GET"], none, ["/list"]) and said(found, "Impl", "save", "spring") == (["POST"], none, ["/save"])
    assert found["Impl", "list", "spring"].sources == ["method:demo.Api#list()Ljava/lang/String;"]
    assert said(found, "Impl", "def", "spring") == (["GET"], none, ["/def"]) and found["Impl", "def", "spring"].declaring_id == found["Api", "def", "spring"].class_id
    assert said(found, "Sub", "list", "spring") == (["GET"], none, ["/list"]) and found["Sub", "save", "spring"].declaring_id == found["Impl", "save", "spring"].class_id
    assert said(found, "Diamond", "list", "spring") == (["GET"], none, ["/list"])
    assert said(found, "GenImpl", "put", "spring") == (["POST"], none, ["/gen"])
    # two interfaces disagree; a supertype is unknown
    assert said(found, "Conf", "m", "spring") is None and said(found, "Lost", "list", "spring") is None
    # the class's own mapping isn't known either where a supertype is lost
    assert said(found, "Lost", "own", "spring") is None
    assert said(found, "Based", "list", "spring") == (["GET"], ["/base"], ["/list"]) and said(found, "Below", "list", "spring") == (["GET"], ["/base"], ["/list"])
    assert said(found, "Below", "save", "spring") is None  # its own annotation has no clear meaning and hides the others
    assert found["Based", "list", "spring"].sources == ["class:demo.Based", "method:demo.Api#list()Ljava/lang/String;"]


def test_rest_routes(found):
    assert said(found, "R", "x", "jax-rs") == (["GET"], ["/r"], ["x"]) and said(found, "R", "c", "jax-rs") == (["PURGE"], ["/r"], [""]) and said(found, "R", "sub", "jax-rs") == (["SUBRESOURCE"], ["/r"], ["sub"])
    assert said(found, "R", "hidden", "jax-rs") is None and said(found, "R", "none", "jax-rs") is None
    assert said(found, "JImpl", "j", "jax-rs") == (["GET"], [""], ["/j"]) and said(found, "JBoth", "j", "jax-rs") == (["POST"], [""], ["/j2"]) and said(found, "JConf", "j", "jax-rs") is None
    assert said(found, "Derived", "k", "jax-rs") == (["POST"], [""], [""]) and said(found, "Own", "k", "jax-rs") == (["GET"], [""], [""])
    assert said(found, "Param", "p", "jax-rs") is None  # an annotation of its own parameter hides the interface's


def test_filters(index):
    rows = search.declared_endpoints(index, framework="spring", http_method="PUT", path_prefix="/api").collect()
    assert {(r.name, r.path) for r in rows} == {("p", "/api/p"), ("d", "/api/deep"), ("w", "/api/w"), ("f", "/api/fixed"), ("one", "/api/1"), ("loop", "/api/loop"), ("any", "/api")}
    assert search.declared_endpoints(index, framework="jax-rs", module="web", source_set="main").count() > 5
    assert search.declared_endpoints(index, module="other").isEmpty() and search.declared_endpoints(index, source_set="test").isEmpty()
