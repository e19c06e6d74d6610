"""Java class files as rows: classes, members, annotations, calls, field accesses, references.

The format is the one that the Java Virtual Machine Specification describes. One file is one task's
row: files come from Spark's ``binaryFile`` source (or out of JARs) and are parsed where they are read.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import ship

# Access flags, constant sizes and instruction lengths of the class-file format.
CLASS_FLAGS = {0x0001: "public", 0x0010: "final", 0x0200: "interface", 0x0400: "abstract", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum"}
FIELD_FLAGS = {0x0001: "public", 0x0002: "private", 0x0004: "protected", 0x0008: "static", 0x0010: "final", 0x0040: "volatile", 0x0080: "transient", 0x1000: "synthetic"}
METHOD_FLAGS = {0x0001: "public", 0x0002: "private", 0x0004: "protected", 0x0008: "static", 0x0010: "final", 0x0020: "synchronized", 0x0040: "bridge", 0x0100: "native", 0x0400: "abstract", 0x1000: "synthetic"}
INVOKES = {182: "virtual", 183: "special", 184: "static", 185: "interface", 186: "dynamic"}
FIELDS = {178: "read_static", 179: "write_static", 180: "read_instance", 181: "write_instance"}
_ONE = {16, 18, *range(21, 26), *range(54, 59), 169, 188}
_TWO = {17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199}
_FOUR = {185, 186, 200, 201}
_RETURNS = {*range(172, 178), 191}
# Methods that take a configuration key or a resource's path first: the type that has them (or a subtype, where it is
# an interface of a library), and what they are.
CONSTANT_APIS = (
    ("java.lang.System", "getProperty", "config_key"), ("java.lang.System", "getenv", "config_key"), ("java.lang.Integer", "getInteger", "config_key"), ("java.lang.Boolean", "getBoolean", "config_key"),
    ("org.springframework.core.env.Environment", "getProperty", "config_key"), ("org.springframework.core.env.Environment", "getRequiredProperty", "config_key"),
    ("org.eclipse.microprofile.config.Config", "getValue", "config_key"), ("org.eclipse.microprofile.config.Config", "getOptionalValue", "config_key"),
    ("java.lang.Class", "getResource", "resource"), ("java.lang.Class", "getResourceAsStream", "resource"), ("java.lang.ClassLoader", "getResource", "resource"), ("java.lang.ClassLoader", "getResourceAsStream", "resource"),
    ("org.springframework.core.io.ResourceLoader", "getResource", "resource"), ("java.util.ResourceBundle", "getBundle", "resource_bundle"),
)
LOOKUPS = {name for _, name, _ in CONSTANT_APIS}


@dataclass
class ClassFile:
    """What a class file says."""

    name: str
    superclass: str | None
    interfaces: list[str]
    kind: str
    flags: list[str]
    source_file: str | None = None
    annotations: list[str] = field(default_factory=list)
    values: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    accesses: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    flow: list[dict] = field(default_factory=list)
    lookups: list[dict] = field(default_factory=list)
    defaults: list[dict] = field(default_factory=list)
    signature: str | None = None


_PARAMETER = re.compile(r"\[*(?:L[^;]+;|[ZBCSIJFD])")


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, code: str) -> int:
        value = struct.unpack_from(">" + code, self.data, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def _dotted(name: str) -> str:
    return name.replace("/", ".")


def _type_name(descriptor: str) -> str | None:
    inner = descriptor.lstrip("[")
    return _dotted(inner[1:-1]) if inner.startswith("L") else None


def _flags(value: int, names: dict[int, str]) -> list[str]:
    return [n for bit, n in names.items() if value & bit]


class _Pool:
    def __init__(self, r: _Reader) -> None:
        self.items: list = [None] * r.take("H")
        k = 1
        while k < len(self.items):
            tag = r.take("B")
            if tag == 1:
                self.items[k] = r.bytes(r.take("H")).decode("utf-8", "replace")
            elif tag in (3, 4):
                self.items[k] = ("number", r.take("i")) if tag == 3 else ("number", r.take("f"), r.data[r.at - 4 : r.at].hex())
            elif tag in (5, 6):
                self.items[k] = ("number", r.take("q")) if tag == 5 else ("number", r.take("d"), r.data[r.at - 8 : r.at].hex())
                k += 1
            elif tag in (7, 8, 16, 19, 20):
                self.items[k] = (tag, r.take("H"))
            elif tag == 15:
                self.items[k] = (tag, r.take("B"), r.take("H"))
            else:
                self.items[k] = (tag, r.take("H"), r.take("H"))
            k += 1

    def text(self, k: int) -> str | None:
        return self.items[k] if k else None

    def constant(self, k: int) -> str | None:
        """A field's constant: a text, or a number as text, with its bits where it isn't whole."""
        item = self.items[k]
        return self.text(item[1]) if item[0] == 8 else " ".join(map(str, item[1:]))

    def class_name(self, k: int) -> str | None:
        return _dotted(self.items[self.items[k][1]]) if k else None

    def member(self, k: int) -> tuple[str | None, str, str]:
        """(owner, name, descriptor); no owner for a dynamic call."""
        tag, owner, pair = self.items[k]
        _, name, descriptor = self.items[pair]
        return (None if tag in (17, 18) else self.class_name(owner)), self.items[name], self.items[descriptor]


def parse(data: bytes) -> ClassFile:
    """Parse one class file; raises ValueError if it isn't one."""
    r = _Reader(data)
    if len(data) < 10 or r.take("I") != 0xCAFEBABE:
        raise ValueError("not a class file")
    r.take("I")
    pool = _Pool(r)
    access, this, parent = r.take("H"), r.take("H"), r.take("H")
    faces = [pool.class_name(r.take("H")) for _ in range(r.take("H"))]
    flags = _flags(access, CLASS_FLAGS)
    kind = "ANNOTATION" if "annotation" in flags else "INTERFACE" if "interface" in flags else "ENUM" if "enum" in flags else "CLASS"
    out = ClassFile(pool.class_name(this), pool.class_name(parent), faces, kind, [f for f in flags if f not in ("interface", "annotation", "enum")])
    for names, member_kind in ((FIELD_FLAGS, "FIELD"), (METHOD_FLAGS, "METHOD")):
        for _ in range(r.take("H")):
            value, name, descriptor = r.take("H"), pool.text(r.take("H")), pool.text(r.take("H"))
            row = {"kind": "CONSTRUCTOR" if name == "<init>" else member_kind, "name": name, "descriptor": descriptor, "modifiers": _flags(value, names), "annotations": [], "signature": None, "constant": None, "exceptions": []}
            out.members.append(row)
            for attribute, body in _attributes(r, pool):
                if attribute in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                    _mark(out, row["annotations"], _annotations(body, pool), name, descriptor)
                elif attribute in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations"):
                    for k, found in enumerate(_parameter_annotations(body, pool)):
                        _mark(out, [], found, name, descriptor, k)
                elif attribute == "AnnotationDefault":
                    out.defaults.append({"element": name, "values": _annotation_value(_Reader(body), pool)})
                elif attribute == "Signature":
                    row["signature"] = pool.text(struct.unpack(">H", body)[0])
                elif attribute == "Exceptions":
                    thrown = _Reader(body)
                    row["exceptions"] = sorted(pool.class_name(thrown.take("H")) for _ in range(thrown.take("H")))
                elif attribute == "ConstantValue":
                    row["constant"] = pool.constant(struct.unpack(">H", body)[0])
                elif attribute == "Code":
                    _code(body, pool, out, name, descriptor)
    for attribute, body in _attributes(r, pool):
        if attribute == "SourceFile":
            out.source_file = pool.text(struct.unpack(">H", body)[0])
        elif attribute == "InnerClasses":
            # what a nested class was declared as is there, not in its own flags
            inner = _Reader(body)
            for _ in range(inner.take("H")):
                name, _, _, own = (inner.take("H") for _ in range(4))
                if pool.class_name(name) == out.name:
                    out.flags = [f for f in _flags(own, FIELD_FLAGS | CLASS_FLAGS) if f not in ("interface", "annotation", "enum")]
        elif attribute == "Signature":
            out.signature = pool.text(struct.unpack(">H", body)[0])
        elif attribute in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            _mark(out, out.annotations, _annotations(body, pool), "", "")
    return out


def _attributes(r: _Reader, pool: _Pool) -> Iterator[tuple[str, bytes]]:
    for _ in range(r.take("H")):
        name = pool.text(r.take("H"))
        yield name, r.bytes(r.take("I"))


def _annotation_value(r: _Reader, pool: _Pool) -> list[str]:
    """Texts, names of enum constants and classes, and numbers of an element's value; nested annotations have none."""
    tag = chr(r.take("B"))
    if tag == "e":
        r.take("H")
        return [pool.text(r.take("H"))]
    if tag == "@":
        _annotation(r, pool)
        return []
    if tag == "[":
        return [v for _ in range(r.take("H")) for v in _annotation_value(r, pool)]
    at = r.take("H")
    return [pool.text(at)] if tag == "s" else [_type_name(pool.text(at)) or pool.text(at)] if tag == "c" else [str(pool.items[at][1])]


def _annotation(r: _Reader, pool: _Pool) -> tuple[str, dict[str, list[str]]]:
    name = _type_name(pool.text(r.take("H")))
    return name, {pool.text(r.take("H")): _annotation_value(r, pool) for _ in range(r.take("H"))}


def _annotations(body: bytes, pool: _Pool) -> list[tuple[str, dict[str, list[str]]]]:
    """(name, values by element) of the annotations of one attribute."""
    r = _Reader(body)
    return [_annotation(r, pool) for _ in range(r.take("H"))]


def _parameter_annotations(body: bytes, pool: _Pool) -> list[list[tuple[str, dict[str, list[str]]]]]:
    r = _Reader(body)
    return [[_annotation(r, pool) for _ in range(r.take("H"))] for _ in range(r.take("B"))]


def _mark(out: ClassFile, names: list[str], found: list[tuple[str, dict]], member: str, descriptor: str, position: int | None = None) -> None:
    """Add annotations by name, and their values with the place that has them."""
    for name, values in found:
        names.append(name)
        out.values += [{"member": member, "descriptor": descriptor, "position": position, "annotation": name, "element": e, "values": v} for e, v in (values or {"": []}).items()]


class _Machine:
    """The stack and the slots of a method as far as they are known: a text, a class (in a tuple), or None."""

    def __init__(self, pool: _Pool, owner: str, fields: dict[str, str]) -> None:
        self.pool, self.owner, self.fields = pool, owner, fields
        self.stack: list = []
        self.slots: dict[int, object] = {}

    def pop(self, n: int = 1) -> list:
        """The ``n`` values on top, the deepest first; what isn't there is unknown."""
        got = self.stack[-n:] if n else []
        del self.stack[len(self.stack) - len(got) :]
        return [None] * (n - len(got)) + got

    def forget(self) -> None:
        self.stack.clear()
        self.slots.clear()

    def call(self, op: int, descriptor: str) -> tuple[object, list]:
        """(receiver, arguments); the result is unknown."""
        arguments = self.pop(len(parameter_types(descriptor)))
        receiver = self.pop()[0] if op not in (184, 186) else None
        if not descriptor.endswith(")V"):
            self.stack.append(None)
        return receiver, arguments

    def step(self, code: bytes, at: int) -> None:
        """An instruction that isn't a call. What it isn't known to leave as it is makes the stack unknown, a jump everything."""
        op, stack = code[at], self.stack
        wide = op == 196
        if wide:
            op = code[at + 1]
        slot = (struct.unpack_from(">H", code, at + 2)[0] if wide else code[at + 1]) if at + 1 < len(code) else 0
        if 21 <= op <= 45:
            stack.append(self.slots.get(slot if op <= 25 else (op - 26) % 4))
        elif 54 <= op <= 78:
            self.slots[slot if op <= 58 else (op - 59) % 4] = self.pop()[0]
        elif op in (18, 19, 20):
            item = self.pool.items[code[at + 1] if op == 18 else struct.unpack_from(">H", code, at + 1)[0]]
            stack.append(self.pool.text(item[1]) if item and item[0] == 8 else (_dotted(self.pool.text(item[1])),) if item and item[0] == 7 else None)
        elif 1 <= op <= 8 or op in (16, 17, 187):
            stack.append(None)
        elif op == 89:
            stack.append(stack[-1] if stack else None)
        elif op == 178:
            owner, name, _ = self.pool.member(struct.unpack_from(">H", code, at + 1)[0])
            stack.append(self.fields.get(name) if owner == self.owner else None)
        elif op in (180, 189):
            self.pop()
            stack.append(None)
        elif op in (87, 172, 174, 176, 179):
            self.pop()
        elif op in (88, 173, 175, 181):
            self.pop(2)
        elif 153 <= op <= 168 or 198 <= op <= 201:
            self.forget()
        elif op not in (0, 132, 170, 171, 177, 192, 193, 197):
            stack.clear()


def parameter_types(descriptor: str) -> list[str]:
    """The descriptors of a method's parameters."""
    return _PARAMETER.findall(descriptor[1 : descriptor.rindex(")")])


def _code(body: bytes, pool: _Pool, out: ClassFile, method: str, descriptor: str) -> None:
    """Collect what a method's instructions refer to, and the order they can run in."""
    r = _Reader(body)
    r.take("I")
    code = r.bytes(r.take("I"))
    handlers = [struct.unpack(">HHHH", r.bytes(8))[2] for _ in range(r.take("H"))]
    lines: list[tuple[int, int]] = []
    for attribute, table in _attributes(r, pool):
        if attribute == "LineNumberTable":
            lines += [struct.unpack_from(">HH", table, 2 + 4 * k) for k in range(struct.unpack_from(">H", table)[0])]
    lines.sort()
    place = {"method": method, "descriptor": descriptor}
    at, line = 0, None
    leaders, steps, reached = {0}, [], {*handlers}
    while at < len(code):
        size, targets = _shape(code, at)
        reached.update(targets or ())
        at += size
    at = 0
    machine = _Machine(pool, out.name, {m["name"]: m["constant"] for m in out.members if m["kind"] == "FIELD" and m["descriptor"] == "Ljava/lang/String;" and {"static", "final"} <= {*m["modifiers"]}})
    upcoming = iter(lines)
    following = next(upcoming, None)
    while at < len(code):
        while following and following[0] <= at:
            line, following = following[1], next(upcoming, None)
        op = code[at]
        index = struct.unpack_from(">H", code, at + 1)[0] if at + 2 < len(code) else 0
        size, targets = _shape(code, at)
        if at in reached:
            machine.forget()
        if op in INVOKES:
            owner, name, to = pool.member(index)
            out.calls.append(place | {"owner": owner, "name": name, "to": to, "invocation_kind": INVOKES[op], "ordinal": at, "line": line})
            receiver, arguments = machine.call(op, to)
            if name in LOOKUPS and to.startswith("(Ljava/lang/String;"):
                value = arguments[0] if isinstance(arguments[0], str) else None
                out.lookups.append(place | {"owner": owner, "name": name, "value": value, "receiver": receiver[0] if isinstance(receiver, tuple) else None, "line": line})
        else:
            machine.step(code, at)
        if op in FIELDS:
            owner, name, to = pool.member(index)
            out.accesses.append(place | {"owner": owner, "name": name, "to": to, "access_kind": FIELDS[op], "ordinal": at, "line": line})
        elif op in (187, 189, 192, 193):
            name = pool.class_name(index)
            if not name.startswith("["):
                out.references.append(place | {"target": name, "reference": "CONSTRUCTS" if op == 187 else "TYPE_USE", "line": line})
        if targets is not None:
            leaders.update(targets)
            leaders.add(at + size)
            steps += [(at, t) for t in targets]
        if op not in (167, 170, 171, 200) and op not in _RETURNS:
            steps.append((at, at + size))
        elif op in _RETURNS:
            leaders.add(at + size)
        at += size
    block = {}
    for leader in sorted(x for x in leaders if x < len(code)):
        block[leader] = leader
    starts = sorted(block)
    home = lambda x: max((b for b in starts if b <= x), default=0) if len(starts) < 64 else starts[_place(starts, x)]
    edges = {(home(a), home(b)) for a, b in steps if b < len(code) and b in block}
    out.flow += [place | {"src": a, "dst": b} for a, b in sorted(edges)]


def _place(starts: list[int], x: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, x) - 1


def _shape(code: bytes, at: int) -> tuple[int, list[int] | None]:
    """An instruction's length, and where it may jump."""
    op = code[at]
    if 153 <= op <= 168 or op in (198, 199):
        return 3, [at + struct.unpack_from(">h", code, at + 1)[0]]
    if op in (200, 201):
        return 5, [at + struct.unpack_from(">i", code, at + 1)[0]]
    if op in (170, 171):
        base = at + 4 - at % 4
        default = struct.unpack_from(">i", code, base)[0]
        if op == 170:
            low, high = struct.unpack_from(">ii", code, base + 4)
            jumps = struct.unpack_from(f">{high - low + 1}i", code, base + 12)
            return base + 12 + 4 * len(jumps) - at, [at + default, *(at + j for j in jumps)]
        n = struct.unpack_from(">i", code, base + 4)[0]
        jumps = [struct.unpack_from(">i", code, base + 12 + 8 * k)[0] for k in range(n)]
        return base + 8 + 8 * n - at, [at + default, *(at + j for j in jumps)]
    if op == 196:
        return 6 if code[at + 1] == 132 else 4, None
    if op == 197:
        return 4, None
    return (2 if op in _ONE else 3 if op in _TWO else 5 if op in _FOUR else 1), None


_SCHEMA = """path string, class_name string, superclass string, interfaces array<string>, kind string, flags array<string>, source_file string, annotations array<string>,
    values array<struct<member:string,descriptor:string,position:int,annotation:string,element:string,values:array<string>>>,
    members array<struct<kind:string,name:string,descriptor:string,modifiers:array<string>,annotations:array<string>,signature:string,constant:string,exceptions:array<string>>>,
    calls array<struct<method:string,descriptor:string,owner:string,name:string,to:string,invocation_kind:string,ordinal:int,line:int>>,
    accesses array<struct<method:string,descriptor:string,owner:string,name:string,to:string,access_kind:string,ordinal:int,line:int>>,
    references array<struct<method:string,descriptor:string,target:string,reference:string,line:int>>,
    flow array<struct<method:string,descriptor:string,src:int,dst:int>>,
    lookups array<struct<method:string,descriptor:string,owner:string,name:string,value:string,receiver:string,line:int>>,
    defaults array<struct<element:string,values:array<string>>>, signature string, problem string"""


def parsed_classes(files: DataFrame) -> DataFrame:
    """One row for each class in ``files`` (path, content): class files, and those inside JARs. A file that
    can't be read gives a row with a problem. Null content gives no row."""
    ship(files.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(_SCHEMA)
    arrow = to_arrow_schema(kind)

    def rows(path: str, data: bytes) -> Iterator[dict]:
        if path.endswith(".jar"):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as jar:
                    for name in jar.namelist():
                        if name.endswith(".class"):
                            yield from rows(f"{path}!/{name}", jar.read(name))
            except zipfile.BadZipFile as e:
                yield {"path": path, "problem": str(e)}
            return
        try:
            c = parse(data)
        except (ValueError, IndexError, struct.error, TypeError) as e:
            yield {"path": path, "problem": str(e) or type(e).__name__}
            return
        yield {"path": path, "class_name": c.name} | {k: getattr(c, k) for k in ("superclass", "interfaces", "kind", "flags", "source_file", "annotations", "values", "members", "calls", "accesses", "references", "flow", "lookups", "defaults", "signature")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in rows(path, data.as_py()) if data.is_valid else ():
                    held.append({f.name: row.get(f.name) for f in arrow})
                    if len(held) >= 256:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return files.select("path", "content").mapInArrow(run, kind)


def read_class_files(spark, root: str, glob: str = "*.class") -> DataFrame:
    """Class files (or JARs, by glob) below a folder, parsed."""
    return parsed_classes(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root))


def class_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem is null").select("class_name", "kind", "superclass", "interfaces", "source_file", "path")


def member_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("class_name", F.explode("members").alias("m")).select("class_name", "m.*")


def annotation_values(parsed: DataFrame) -> DataFrame:
    """(class_name, member, descriptor, position, annotation, element, values): what annotations of classes (no member), members and their
    parameters (position) say; one row for each element, with an empty one for annotations without any."""
    return parsed.select("class_name", "kind", F.explode("values").alias("v")).select("class_name", "kind", "v.*")


# The annotation that makes an element the alias of another one.
ALIAS = "org.springframework.core.annotation.AliasFor"


def annotation_elements(parsed: DataFrame) -> DataFrame:
    """(annotation, element, default_values, aliased, alias_annotation, alias_element): the elements of annotations, what they are without a
    value, and of which element, of which annotation (null: their own), they are an alias."""
    own = parsed.where("kind = 'ANNOTATION'")
    elements = own.select(F.col("class_name").alias("annotation"), F.explode("members").alias("m")).where("m.kind = 'METHOD'").select("annotation", F.col("m.name").alias("element"))
    defaults = own.select(F.col("class_name").alias("annotation"), F.explode("defaults").alias("d")).select("annotation", "d.element", F.col("d.values").alias("default_values"))
    said = annotation_values(own).where(F.col("annotation") == ALIAS).select(F.col("class_name").alias("home"), F.col("member").alias("at"), "element", F.try_element_at("values", F.lit(1)).alias("v"))
    of = lambda e: F.max(F.when((F.col("element") == e) & (F.col("v") != ""), F.col("v")))
    aliases = said.groupBy(F.col("home").alias("annotation"), F.col("at").alias("name")).agg(of("annotation").alias("alias_annotation"), F.coalesce(of("attribute"), of("value")).alias("alias_element"), F.lit(True).alias("aliased")).withColumnRenamed("name", "element")
    whole = elements.join(defaults, ["annotation", "element"], "left").join(aliases, ["annotation", "element"], "left")
    return whole.select("annotation", "element", "default_values", F.coalesce("aliased", F.lit(False)).alias("aliased"), "alias_annotation", "alias_element")


def endpoint_marks(parsed: DataFrame) -> DataFrame:
    """(class_name, name, descriptor, annotation, paths, verbs): paths and verbs of annotations that have either by name or by
    element, in the order of the file, joined by line ends. ``path`` goes before ``value``, as one is the other's alias."""
    by = annotation_values(parsed).where("position is null").groupBy("class_name", F.col("member").alias("name"), "descriptor", "annotation")
    of = lambda e: F.max(F.when(F.col("element") == e, F.when(F.size("values") > 0, F.array_join("values", "\n"))))
    return by.agg(F.coalesce(of("path"), of("value"), F.lit("")).alias("paths"), F.coalesce(of("method"), F.lit("")).alias("verbs"))


def jvm_api(parsed: DataFrame) -> DataFrame:
    """(class_name, member, field, value): what class files tell of the API: flags and generic signatures of classes (no member); flags, generic
    signatures, exceptions and constants of members (kind, name and descriptor), static initialisers left out. What is absent is empty. Classes of
    which there are several files have none, as it isn't clear which one counts."""
    one = parsed.where("problem is null").groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("class_name")
    rows = parsed.where("problem is null").join(one, "class_name", "left_semi")
    text = lambda c: F.coalesce(c, F.lit(""))
    fields = lambda **of: F.explode(F.array(*[F.struct(F.lit(k).alias("field"), text(v).alias("value")) for k, v in of.items()])).alias("f")
    flags = F.array_join(F.array_sort(F.array_intersect("flags", F.array(*map(F.lit, ("public", "private", "protected", "static", "final", "abstract", "synthetic"))))), " ")
    classes = rows.select("class_name", F.lit("").alias("member"), fields(flags=flags, signature=F.col("signature")))
    own = rows.select("class_name", F.explode("members").alias("m")).where("m.name <> '<clinit>'")
    of = lambda c: F.col(f"m.{c}")
    members = own.select("class_name", F.concat_ws(" ", of("kind"), of("name"), of("descriptor")).alias("member"), fields(flags=F.array_join(F.array_sort(of("modifiers")), " "), signature=of("signature"), exceptions=F.array_join(of("exceptions"), ","), constant=of("constant")))
    return classes.unionByName(members).select("class_name", "member", "f.field", "f.value")


def call_rows(parsed: DataFrame) -> DataFrame:
    """Calls with their number, lines and places, one row for each caller, target and kind."""
    rows = parsed.select("class_name", F.explode("calls").alias("c")).select("class_name", "c.*")
    keys = ["class_name", "method", "descriptor", "owner", "name", "to", "invocation_kind"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_set("line")).alias("evidence_lines"), F.array_sort(F.collect_set("ordinal")).alias("ordinals"))


def access_rows(parsed: DataFrame) -> DataFrame:
    """Field accesses, grouped like calls."""
    rows = parsed.select("class_name", F.explode("accesses").alias("c")).select("class_name", "c.*")
    keys = ["class_name", "method", "descriptor", "owner", "name", "to", "access_kind"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_set("line")).alias("evidence_lines"))


def flow_edges(parsed: DataFrame) -> DataFrame:
    """(method, src, dst): control flow between blocks, for dominance."""
    rows = parsed.select("class_name", F.explode("flow").alias("f"))
    return rows.select(F.concat_ws("#", "class_name", "f.method", "f.descriptor").alias("method"), "f.src", "f.dst")


def dependency_rows(parsed: DataFrame) -> DataFrame:
    """(from_class, to_class, kind, occurrence_count, evidence_lines): what classes use of others, by kind."""
    calls = parsed.select("class_name", F.explode("calls").alias("c")).select("class_name", F.col("c.owner").alias("target"), F.lit("CALLS").alias("kind"), "c.line")
    fields = parsed.select("class_name", F.explode("accesses").alias("c")).select("class_name", F.col("c.owner").alias("target"), F.lit("FIELD_ACCESS").alias("kind"), "c.line")
    used = parsed.select("class_name", F.explode("references").alias("c")).select("class_name", "c.target", F.col("c.reference").alias("kind"), "c.line")
    rows = calls.unionByName(fields).unionByName(used).where("target is not null AND target <> class_name AND NOT startswith(target, '[')")
    return rows.groupBy(F.col("class_name").alias("from_class"), F.col("target").alias("to_class"), "kind").agg(F.count(F.lit(1)).alias("occurrence_count"), F.array_sort(F.collect_set("line")).alias("evidence_lines"))


def meta_annotations(parsed: DataFrame, *, max_depth: int = 16) -> DataFrame:
    """(class_name, annotation, direct, via): annotations of classes, and those that their annotations have."""
    from codeloom.operators.graph import distances

    direct = parsed.where("problem is null").select("class_name", "kind", F.explode("annotations").alias("annotation"))
    edges = direct.where("kind = 'ANNOTATION'").select(F.col("class_name").alias("src"), F.col("annotation").alias("dst"))
    reach = distances(edges, direct.select(F.col("annotation").alias("origin"), F.col("annotation").alias("node")).distinct(), max_depth=max_depth).where("depth > 0")
    own = direct.select("class_name", "annotation", F.lit(True).alias("direct"), F.lit(None).cast("string").alias("via"))
    meta = direct.join(reach, F.col("annotation") == F.col("origin")).select("class_name", F.col("node").alias("annotation"), F.lit(False).alias("direct"), F.col("origin").alias("via"))
    return own.unionByName(meta).distinct()


def _named_below(parsed: DataFrame, types: DataFrame) -> DataFrame:
    """(owner, api): each of ``types`` (owner) and all parsed classes below it."""
    from codeloom.operators.graph import distances

    up = parsed.where("problem is null").select(F.col("class_name").alias("dst"), F.explode(F.array_compact(F.concat(F.array("superclass"), "interfaces"))).alias("src"))
    reach = distances(up, types.select(F.col("owner").alias("origin"), F.col("owner").alias("node")).distinct())
    return reach.select(F.col("node").alias("owner"), F.col("origin").alias("api"))


def programmatic_usages(parsed: DataFrame) -> DataFrame:
    """(class_name, method, api, usage, value): keys and paths that methods give to known calls (of the type that has them or of one below),
    each once. A method's constants are followed through its stack and local variables and the class's constant fields; what
    isn't known for certain is ``dynamic_config_key`` or ``dynamic_resource``, without a value. A resource's path is
    relative to the package of the class that is asked, where that is known, else of the class that asks; bundles end in ``.properties``."""
    apis = parsed.sparkSession.createDataFrame(CONSTANT_APIS, "api string, name string, usage string")
    # the calls of the types that are final, and of all types below the others
    below = _named_below(parsed, apis.select(F.col("api").alias("owner")))
    calls = parsed.select("class_name", F.explode("lookups").alias("c")).select("class_name", "c.*")
    found = calls.join(below, "owner").join(F.broadcast(apis), ["api", "name"])
    path = F.translate("value", "\\", "/")
    path = F.when(F.col("api") == "org.springframework.core.io.ResourceLoader", F.regexp_replace(path, r"^classpath\*?:", "")).otherwise(path)
    outside = (F.col("api") == "org.springframework.core.io.ResourceLoader") & path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    plain = F.regexp_replace(path, "^/+", "")
    package = F.translate(F.regexp_extract(F.coalesce("receiver", "class_name"), r"^(.*)\.[^.]*$", 1), ".", "/")
    relative = (F.col("api") == "java.lang.Class") & ~path.startswith("/") & (package != "")
    value = (
        F.when(F.col("usage") == "config_key", F.col("value")).when(F.col("usage") == "resource_bundle", F.concat(F.translate(path, ".", "/"), F.lit(".properties")))
        .when(outside, path).when(F.trim(plain) == "", None).when(relative, F.concat(package, F.lit("/"), plain)).otherwise(plain)
    )
    usage = F.when(value.isNull(), F.when(F.col("usage") == "config_key", "dynamic_config_key").otherwise("dynamic_resource")).when(outside & (F.col("usage") == "resource"), "external_resource").otherwise(F.col("usage"))
    return found.select("class_name", "method", F.concat_ws("#", "api", "name").alias("api"), usage.alias("usage"), value.alias("value")).distinct()


def first_by_jar(parsed: DataFrame, order: list[str]) -> DataFrame:
    """Classes of dependency JARs; of a class in several, the one in the JAR that comes first on the class path."""
    from pyspark.sql import Window

    jars = parsed.sparkSession.createDataFrame(list(enumerate(order)), "place long, jar string")
    rows = parsed.where("problem is null").withColumn("jar", F.substring_index(F.substring_index("path", "!/", 1), "/", -1)).join(F.broadcast(jars), "jar")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("class_name").orderBy("place", "path"))).where("n = 1").drop("n")


# Annotations that make a class a bean, with its framework and scope.
BEAN_ANNOTATIONS = (
    ("jakarta.enterprise.context.ApplicationScoped", "cdi", "ApplicationScoped"), ("jakarta.enterprise.context.RequestScoped", "cdi", "RequestScoped"), ("jakarta.enterprise.context.Dependent", "cdi", "Dependent"),
    ("jakarta.inject.Singleton", "cdi", "Singleton"), ("javax.inject.Singleton", "cdi", "Singleton"), ("org.springframework.stereotype.Component", "spring", "singleton"),
    ("org.springframework.stereotype.Service", "spring", "singleton"), ("org.springframework.stereotype.Repository", "spring", "singleton"), ("org.springframework.context.annotation.Configuration", "spring", "singleton"),
)
INJECTING = ("jakarta.inject.Inject", "javax.inject.Inject", "org.springframework.beans.factory.annotation.Autowired")
PRODUCING = ("jakarta.enterprise.inject.Produces", "javax.enterprise.inject.Produces", "org.springframework.context.annotation.Bean")


def discovered_beans(parsed: DataFrame) -> DataFrame:
    """Beans by annotation: concrete classes, and members that produce one; each once, a framework's first rule wins."""
    rules = F.broadcast(parsed.sparkSession.createDataFrame(BEAN_ANNOTATIONS, "annotation string, framework string, scope string"))
    classes = meta_annotations(parsed).join(rules, "annotation").join(parsed.where("kind = 'CLASS' AND NOT array_contains(flags, 'abstract')").select("class_name"), "class_name")
    managed = classes.groupBy("class_name", "framework").agg(F.min("scope").alias("scope")).select("class_name", "framework", "scope", F.lit("MANAGED").alias("kind"), F.lit("").alias("member"))
    of = member_rows(parsed).withColumn("mark", F.explode("annotations")).where(F.col("mark").isin(*PRODUCING))
    produced = of.select("class_name", F.when(F.col("mark").startswith("org.spring"), "spring").otherwise("cdi").alias("framework"), F.lit("Dependent").alias("scope"), F.concat(F.lit("PRODUCER_"), "kind").alias("kind"), F.concat("name", "descriptor").alias("member"))
    return managed.unionByName(produced).distinct()


def discovered_injection_points(parsed: DataFrame) -> DataFrame:
    """Fields, constructors and methods marked for injection, with the type a field wants."""
    of = member_rows(parsed).withColumn("mark", F.explode("annotations")).where(F.col("mark").isin(*INJECTING))
    wanted = F.when(F.col("kind") == "FIELD", F.translate(F.regexp_extract("descriptor", r"^\[*L(.*);$", 1), "/", "."))
    return of.select("class_name", "kind", "name", "descriptor", wanted.alias("target_type")).distinct()
