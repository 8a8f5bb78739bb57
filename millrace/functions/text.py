"""Text scalars over code, messages and diffs, as columns; line work is done by array functions.

Null text gives null, or an empty list where a list is returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that look like method names but are not.
MINING_SKIPS = ("if", "for", "while", "switch", "catch")
SCREEN_SKIPS = ("if", "for", "while", "switch", "catch", "try", "else")
# Words that can stand before a declaration.
MODIFIERS = ("public", "private", "protected", "static", "synchronized", "final")
_WORD, _BLANK, _TYPE = r"[\p{L}\p{N}_]", r"[\s\p{Z}]", r"[\p{L}\p{N}_<>\[\],\s\p{Z}]"
#: What stands before a bracket: words, types and blanks; a name at its end with a blank before it; a name before a bracket.
BEFORE_BRACKET = f"({_TYPE}+)\\("
LAST_NAME = f"{_BLANK}({_WORD}+){_BLANK}*\\z"
NAMED_BRACKET = f"{_BLANK}({_WORD}+){_BLANK}*\\("
#: A modifier or a blank, and something after it.
MODIFIED = f"(?s)(?:{'|'.join(MODIFIERS)}|{_BLANK})."
# Fixed value: a line that declares a method, its name and its parameters.
METHOD = r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:synchronized\s+)?(?:final\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[^{]+)?\s*\{"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda names as a column is computed anew for each item."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of word characters, or one character that is neither a word's nor blank."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("int")


def pair_id(repo: Column, commit: Column, path: Column, signature: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", repo, commit, path, signature), 256), 1, 16)


def issue_ids(message: Column) -> Column:
    """Numbers after #, keys like ABC-12, and numbers after a closing word; sorted and distinct."""
    found = [F.regexp_extract_all(message, F.lit(p), F.lit(1)) for p in (r"#(\d+)", r"([A-Z]+-\d+)", r"(?i)(?:fixes|resolves|closes)\s+#?(\d+)")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def side(diff: Column, sign: str) -> Column:
    """The lines of one side of a diff, without the sign and the file headers."""
    mine = F.filter(lines(diff), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.transform(mine, lambda x: F.substring(x, 2, 1 << 30))


def hunks(diff: Column) -> Column:
    """struct(old_start, old_count, new_start, new_count) of each hunk header; a missing count is 1."""
    heads = F.filter(lines(diff), lambda x: x.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))

    def part(x: Column, pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), F.lit("1")).cast("int")

    return F.transform(
        heads,
        lambda x: F.struct(
            part(x, r"^@@ -(\d+)").alias("old_start"),
            part(x, r"^@@ -\d+,(\d+)").alias("old_count"),
            part(x, r"^@@ -\d+(?:,\d+)? \+(\d+)").alias("new_start"),
            part(x, r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)").alias("new_count"),
        ),
    )


def changed_files(diff: Column, suffix: str = ".java") -> Column:
    heads = F.filter(lines(diff), lambda x: x.startswith("+++ b/") & x.endswith(suffix))
    return F.transform(heads, lambda x: F.substring(x, 7, 1 << 30))


def _declared(text: Column, most: Callable[[Column], Column]) -> Column:
    """Names before brackets, in order, whose text before the blank and the name satisfies ``most``. What stands before a bracket is
    read backwards from it, so that the time is linear in the text."""
    parts = F.split(text, r"\(", -1)
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.reverse(F.regexp_extract(F.reverse(x), rf"\A{_TYPE}++", 0)))
    found = F.transform(F.filter(before, lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, LAST_NAME, 1).alias("name"), F.regexp_replace(x, LAST_NAME, "").alias("rest")))
    return F.transform(F.filter(found, lambda x: (x["name"] != "") & most(x["rest"])), lambda x: x["name"])


def declared(text: Column) -> Column:
    """All names that a type, or anything else than a bracket, stands before."""
    return _declared(text, lambda rest: rest != "")


def changed_methods(diff: Column) -> Column:
    """Names in hunk contexts, and the first in each changed line that a modifier or a blank precedes; sorted and distinct."""
    heads = F.transform(F.filter(lines(diff), lambda x: x.startswith("@@")), lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(NAMED_BRACKET), F.lit(1)), F.lit(-1)))
    edits = F.filter(lines(diff), lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---")))
    first = F.transform(edits, lambda x: F.get(_declared(x, lambda rest: rest.rlike(MODIFIED)), 0))
    names = F.array_except(first, F.array(*[F.lit(w) for w in MINING_SKIPS]))
    return F.array_sort(F.filter(F.array_distinct(F.concat(heads, names)), lambda x: x.isNotNull()))


def braces(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))


_BODY = "struct<active:boolean,done:boolean,depth:int,n:int,body:string>"


def method_body(source: Column, name: Column) -> Column:
    """The first body of a method of that name: from its declaration to the line that closes the braces; a body of
    fewer than two lines is empty. One fold over the lines."""
    start = F.struct(F.lit(False).alias("active"), F.lit(False).alias("done"), F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit("").alias("body")).cast(_BODY)

    def step(a: Column, line: Column) -> Column:
        begins = F.array_contains(declared(line), name)
        depth = a["depth"] + braces(line)
        taken = F.struct(F.lit(True), ~(F.lit(True) & (a["n"] == 0)) & (depth <= 0), depth.cast("int"), a["n"] + 1, F.when(a["n"] == 0, line).otherwise(F.concat(a["body"], F.lit("\n"), line))).cast(_BODY)
        return F.when(a["done"] | (~a["active"] & ~begins), a).otherwise(taken)

    return F.aggregate(lines(source), start, step, lambda a: F.when(a["n"] >= 2, a["body"]).otherwise(""))


def methods(source: Column) -> Column:
    """struct(name, signature, start_line, end_line, source) of every line that declares a method. The end is the first
    later line at which the braces balance, or the line itself if none does. One fold over the lines for all methods."""
    none = F.array().cast("array<int>")

    def one(ls: Column, x: Column) -> Column:
        line, start = F.get(ls, x["start"]), x["start"]
        end = F.when(x["end"] < 0, start).otherwise(x["end"])
        name, params = F.regexp_extract(line, METHOD, 1), F.regexp_extract(line, METHOD, 2)
        return F.struct(
            name.alias("name"),
            F.lit("Unknown").alias("class_name"),
            F.concat(F.lit("Unknown."), name, F.lit("("), params, F.lit(")")).alias("signature"),
            (start + 1).alias("start_line"),
            (end + 1).alias("end_line"),
            F.array_join(F.slice(ls, start + 1, end - start + 1), "\n").alias("source"),
        )

    def split(ls: Column) -> Column:
        marks = F.transform(ls, lambda line, i: F.struct(i.alias("at"), braces(line).alias("up"), F.when(line.rlike(METHOD), F.array(i)).otherwise(none).alias("names")))
        return F.transform(_spans(marks, lambda now, base: now == base, "int"), lambda x: one(ls, x))

    return let(lines(source), split)


def _spans(marks: Column, closed: Callable[[Column, Column], Column], kind: str) -> Column:
    """struct(start, end, name) of everything that begins on a line, in order; the end is the first later line at which ``closed`` holds for the
    sum of braces so far and that before the start, else -1. marks: struct(at, up, names) of each line; names: what begins there."""
    item = f"struct<start:int,end:int,base:int,name:{kind}>"
    state = f"struct<depth:int,open:array<{item}>,done:array<{item}>>"

    def step(a: Column, x: Column) -> Column:
        now = a["depth"] + x["up"]
        ends = F.filter(a["open"], lambda o: closed(now, o["base"]))
        begun = F.transform(x["names"], lambda n: F.struct(x["at"].alias("start"), F.lit(-1).alias("end"), a["depth"].alias("base"), n.alias("name")).cast(item))
        left = F.filter(a["open"], lambda o: ~closed(now, o["base"]))
        more = F.transform(ends, lambda o: F.struct(o["start"].alias("start"), x["at"].alias("end"), o["base"].alias("base"), o["name"].alias("name")).cast(item))
        idle = (F.size(ends) == 0) & (F.size(x["names"]) == 0)
        same = F.struct(now.cast("int").alias("depth"), a["open"].alias("open"), a["done"].alias("done")).cast(state)
        return F.when(idle, same).otherwise(F.struct(now.cast("int").alias("depth"), F.concat(left, begun).alias("open"), F.concat(a["done"], more).alias("done")).cast(state))

    none = F.array().cast(f"array<{item}>")
    start = F.struct(F.lit(0).alias("depth"), none.alias("open"), none.alias("done")).cast(state)
    return F.array_sort(F.aggregate(marks, start, step, lambda a: F.concat(a["done"], a["open"])))


def method_bodies(source: Column, names: Column) -> Column:
    """struct(name, start_line, end_line, body) of the first body of each of ``names`` that ``source`` has, as ``method_body`` finds it, by one
    fold for all names."""
    item = "array<struct<start:int,end:int,base:int,name:string>>"

    def unless_seen(a: Column, x: Column) -> Column:
        return F.when(F.exists(a, lambda y: y["name"] == x["name"]), a).otherwise(F.concat(a, F.array(x)))

    def one(ls: Column, x: Column) -> Column:
        end = F.when(x["end"] < 0, F.size(ls) - 1).otherwise(x["end"])
        body = F.array_join(F.slice(ls, x["start"] + 1, end - x["start"] + 1), "\n")
        return F.struct(x["name"].alias("name"), (x["start"] + 1).alias("start_line"), (end + 1).alias("end_line"), body.alias("body"))

    def found(ls: Column) -> Column:
        marks = F.transform(ls, lambda line, i: F.struct(i.alias("at"), braces(line).alias("up"), F.array_intersect(declared(line), names).alias("names")))
        firsts = F.aggregate(_spans(marks, lambda now, base: now <= base, "string"), F.array().cast(item), unless_seen)
        return F.filter(F.transform(firsts, lambda x: one(ls, x)), lambda x: x["end_line"] > x["start_line"])

    return let(lines(source), found)


# Words of a method's head that are no type or no name of one.
NO_TYPE = "public private protected static final abstract synchronized native strictfp default transient volatile sealed new return throw else case assert do yield instanceof package import".split()
NO_NAME = "if for while switch catch synchronized try return super this new throw assert".split()
#: Parts of a source: strings, characters and comments, arguments of annotations, and what stands between them. ``*+`` and ``++`` give nothing back.
LEXEMES = (
    r'(?s)"""(?:[^"\\]++|\\.|"{1,2}(?!"))*+"""|"(?:[^"\\\n]++|\\.)*+"|'
    r"'(?:[^'\\\n]++|\\.)*+'|//[^\n]*+|/\*(?:[^*]++|\*++(?!/))*+(?:\*/|\z)|"
    r"""@[\p{L}\p{N}_$.]++\s*+\((?:[^()"']++|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|\((?:[^()"']++|"(?:[^"\\\n]++|\\.)*+")*+\))*+\)|[^"'/@]++|."""
)
SEGMENT = r"[^{};]*+[{};]"
_NAME = r"[\p{L}\p{N}_$]"
#: A head of a class, and what it declares: class, interface, enum (which name methods), record or annotation.
CLASS_HEAD = rf"(?s)(?:\A|[^\p{{L}}\p{{N}}_$.])(@?(?:class|interface|enum|record))\s+({_NAME}+)"
#: A head of a body that has no name: of an object or an enum's constant.
OBJECT_HEAD = rf"(?s)(?:\A|[^\p{{L}}\p{{N}}_$])new\s[\p{{L}}\p{{N}}_$.\s]+(?:<[^(]*>)?\s*\(.*\)\s*\z"
CONSTANT_HEAD = rf"(?s)\A[,\s]*(?:@{_NAME}+\s+)*{_NAME}+\s*(?:\(.*\))?\s*\z"
#: A head of a method: what stands before its parameters, and the parameters.
METHOD_HEAD = rf"(?s)\A([^(=]*{_NAME}\s*)(\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))\s*(?:\[\s*\]\s*)*(?:throws\s[^()=]*)?\z"
_GENERIC = "<(?:[^<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)*>"
#: A type and a name at the end of what stands before parameters.
TYPED_NAME = rf"(?s)(?:\A|[^\p{{L}}\p{{N}}_$.@])([\p{{L}}\p{{N}}_$.]+)(?:\s*{_GENERIC}\s*|\s*(?:\[\s*\]\s*)+|\s+)(?:\[\s*\]\s*)*({_NAME}+)\s*\z"


def bare(source: Column) -> Column:
    """A source of the same length and lines without strings, characters, comments and arguments of annotations: blanks stand in their place."""
    quiet = lambda x: F.regexp_replace(x, r"[^\n]", " ")
    note = lambda x: F.concat(F.regexp_extract(x, r"\A@[\p{L}\p{N}_$.]+", 0), quiet(F.regexp_replace(x, r"\A@[\p{L}\p{N}_$.]+", "")))
    kept = lambda x: F.when(x.rlike(r"\A(?:\"|'|//|/\*)"), quiet(x)).when(x.startswith("@") & (F.length(x) > 1), note(x)).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(source, F.lit(LEXEMES), F.lit(0)), kept), "")


_PLACE = "struct<line:int,col:int>"
_SCOPE = f"struct<kind:string,owner:string,name:string,params:string,start:{_PLACE}>"
_FOUND = f"struct<start:{_PLACE},end:{_PLACE},name:string,class_name:string,params:string>"


def _place(line: Column, col: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col")).cast(_PLACE)


def _extent(text: Column) -> Column:
    """Line ends of a text, its length, and the length of its last line."""
    return F.struct(F.regexp_count(text, F.lit("\n")).alias("lines"), F.length(text).alias("size"), F.length(F.substring_index(text, "\n", -1)).alias("tail"))


def _after(at: Column, extent: Column) -> Column:
    """The place that lies an extent behind another."""
    return _place(at["line"] + extent["lines"], F.when(extent["lines"] > 0, extent["tail"]).otherwise(at["col"] + extent["size"]))


def _between(ls: Column, start: Column, end: Column) -> Column:
    """The text between two places, from its own lines alone."""
    rest = F.length(F.get(ls, end["line"])) - end["col"]
    return let(F.array_join(F.slice(ls, start["line"] + 1, end["line"] - start["line"] + 1), "\n"), lambda t: F.substring(t, start["col"] + 1, F.length(t) - start["col"] - rest))


def scoped_methods(source: Column) -> Column:
    """struct(name, class_name, signature, start_line, end_line, source) of every method that a class, interface, enum, record or object
    declares, with a body or without, in order. The class is the nearest named class, interface or enum around it, else Unknown; a method reaches
    from its first annotation or modifier to its closing brace. Constructors and elements of annotations are no methods.

    One fold over the pieces that end in a brace or a semicolon, with a stack of what they open; strings, characters and comments are
    blanks by then. A method that is never closed is left out."""
    state = f"struct<at:{_PLACE},stack:array<{_SCOPE}>,found:array<{_FOUND}>>"
    scopes, none = f"array<{_SCOPE}>", F.array().cast(f"array<{_FOUND}>")

    def piece(x: Column) -> Column:
        """What a piece says by itself: its end and extent, and its head's blanks, class and method."""

        def parts(head: Column, before: Column) -> Column:
            kind, name = F.regexp_extract(before, TYPED_NAME, 1), F.regexp_extract(before, TYPED_NAME, 2)
            return F.struct(
                F.right(x, F.lit(1)).alias("end"), _extent(x).alias("all"), _extent(F.regexp_extract(head, r"(?s)\A\s*", 0)).alias("lead"),
                F.when(~kind.isin(*NO_TYPE) & ~name.isin(*NO_NAME), name).otherwise("").alias("name"), _extent(before).alias("before"), _extent(F.regexp_extract(head, METHOD_HEAD, 2)).alias("params"),
                F.regexp_extract(head, CLASS_HEAD, 1).alias("kind"), F.regexp_extract(head, CLASS_HEAD, 2).alias("class"), head.rlike(OBJECT_HEAD).alias("object"), head.rlike(CONSTANT_HEAD).alias("constant"),
            )

        return let(F.substring(x, F.lit(1), F.length(x) - 1), lambda head: let(F.regexp_extract(head, METHOD_HEAD, 1), lambda before: parts(head, before)))

    def split(ls: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            top = F.try_element_at(a["stack"], F.lit(-1))
            owner = F.coalesce(top["owner"], F.lit("Unknown"))
            method = (x["name"] != "") & F.coalesce(top["kind"].isin("class", "interface", "enum", "record", "object"), F.lit(False))
            now = _after(a["at"], x["all"])

            def scope(kind: Column, owner: Column) -> Column:
                opens = _after(a["at"], x["before"])
                params = F.when(method, _between(ls, opens, _after(opens, x["params"]))).otherwise("")
                return F.struct(kind.alias("kind"), owner.alias("owner"), x["name"].alias("name"), params.alias("params"), _after(a["at"], x["lead"]).alias("start")).cast(_SCOPE)

            other = F.when(x["object"] | ((top["kind"] == "enum") & x["constant"]), "object").otherwise("block")
            kind = F.when(x["kind"] != "", x["kind"]).when(method, "method").otherwise(other)
            named = F.when(x["kind"].isin("class", "interface", "enum"), x["class"]).otherwise(owner)

            def found(s: Column) -> Column:
                return F.array(F.struct(s["start"].alias("start"), now.alias("end"), s["name"].alias("name"), s["owner"].alias("class_name"), s["params"].alias("params")).cast(_FOUND))

            shut, opens = x["end"] == "}", x["end"] == "{"
            stack = F.when(opens, F.concat(a["stack"], F.array(scope(kind, named)))).when(shut, F.slice(a["stack"], F.lit(1), F.greatest(F.size(a["stack"]) - 1, F.lit(0)))).otherwise(a["stack"])
            done = F.when(shut & (top["kind"] == "method"), F.concat(a["found"], found(top))).when(~shut & ~opens & method, F.concat(a["found"], found(scope(F.lit("method"), owner)))).otherwise(a["found"])
            return F.struct(now.alias("at"), stack.cast(scopes).alias("stack"), done.alias("found")).cast(state)

        def one(x: Column) -> Column:
            signature = F.concat(x["class_name"], F.lit("."), x["name"], x["params"])
            first, last = x["start"]["line"] + 1, x["end"]["line"] + 1
            return F.struct(x["name"].alias("name"), x["class_name"].alias("class_name"), signature.alias("signature"), first.alias("start_line"), last.alias("end_line"), _between(ls, x["start"], x["end"]).alias("source"))

        begin = F.struct(_place(F.lit(0), F.lit(0)).alias("at"), F.array().cast(scopes).alias("stack"), none.alias("found")).cast(state)
        pieces = F.transform(F.regexp_extract_all(bare(source), F.lit(SEGMENT), F.lit(0)), piece)
        return F.transform(F.array_sort(F.aggregate(pieces, begin, step, lambda a: a["found"])), one)

    return let(lines(source), split)


def windows(items: Column, size: int = 512, step: int = 128) -> Column:
    """Sliding windows; the last one is cut short, and none follows once the end is reached."""
    n = F.size(items)
    starts = F.sequence(F.lit(0), F.floor((F.greatest(n - size, F.lit(0)) + step - 1) / step).cast("int"))
    return F.transform(starts, lambda i: F.slice(items, i * step + 1, F.lit(size)))


def window_heads(items: Column, size: int = 512, step: int = 128) -> Column:
    """struct(size, head) of each of ``windows``, without the windows themselves."""
    n = F.size(items)
    starts = F.sequence(F.lit(0), F.floor((F.greatest(n - size, F.lit(0)) + step - 1) / step).cast("int"))
    return F.transform(starts, lambda i: F.struct(F.greatest(F.least(n - i * step, F.lit(size)), F.lit(0)).alias("size"), F.get(items, i * step).alias("head")))


def code_tokens(text: Column, signs: bool = False) -> Column:
    """Identifiers of code for sequence models, with brackets and semicolons if ``signs``."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*" + (r"|[{}();]" if signs else "")), F.lit(0))


def padded(items: Column, size: int, fill: Column) -> Column:
    """The first ``size`` items, filled up at the end."""
    return F.concat(F.slice(items, F.lit(1), F.lit(size)), F.array_repeat(fill, F.greatest(F.lit(0), size - F.size(items))))


def mean_of(parts: Column, width: int) -> Column:
    """The element-wise mean of an array of vectors of one width; null if there are none."""
    n = F.size(parts)
    total = F.aggregate(parts, F.array_repeat(F.lit(0.0), width), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(n > 0, F.transform(total, lambda x: x / n))
