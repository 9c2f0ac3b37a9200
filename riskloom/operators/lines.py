"""Unified diffs as tables of lines and files, and projections of them.

A diff is parsed in its row: parsing needs no shuffle and no window, and works on streams. Only lines that may be headers go
through a fold; the lines after each, up to the next such line, are one step of it, by counts of their marks. The fold holds
no text of lines, since a function over arrays copies what it gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import COMMENT_MARKERS, CONFIG_FILE, DOC_FILE, LANES, PATHS
from riskloom.functions import any_match, let

_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def code_to_patch(code: DataFrame) -> DataFrame:
    """change_id, path, code -> change_id, diff: each row as a new file; null code is an empty file."""
    lines = F.split(F.coalesce("code", F.lit("")), "\n")
    head = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"), F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), F.col("path"), F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"))
    return code.select("change_id", F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n")).alias("diff"))


def assemble_diffs(patches: DataFrame) -> DataFrame:
    """change_id, ord, path, patch -> change_id, diff: patches in order, each under a file header; empty ones are left out."""
    part = F.struct("ord", F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"), "patch").alias("t"))
    return patches.where("patch is not null and patch <> ''").groupBy("change_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n").alias("diff"))


#: The most lines of a piece, and pieces of a chunk: an array grows by being copied, so a long one is made of parts.
CHUNK = 64
#: Lines that may say something of hunks or files.
_MARKER = r"^(?:@@|diff --git |--- |\+\+\+ |rename to |copy to |new file mode |deleted file mode )"
#: What parsing gives for a diff: its body lines and its files.
LINE = "struct<file_no:int,path:string,hunk_no:int,ord:int,type:string,content:string,line_number:int,other_line:int,is_new:boolean,is_deleted:boolean>"
FILE = "struct<file_no:int,path:string,added:bigint,removed:bigint,is_new:boolean,is_deleted:boolean,broken:boolean>"
#: What the fold gives for a piece with body lines: its number, whether its first line is none of them, the counts before them
#: and in them, and what holds for all of them.
_BODY = "struct<no:int,first:int,base:bigint,c:bigint,file_no:int,path:string,hunk_no:int,at_old:bigint,at_new:bigint,is_new:boolean,is_deleted:boolean>"
#: Counts of added, removed and context lines of a piece in one number.
_ADDED, _REMOVED, _CONTEXT = 1, 1 << 20, 1 << 40
#: The state of the fold: the hunk (numbers of its header, lines of either side so far), the file (what its headers said,
#: lines so far, lines of either side in the present hunk, whether that hunk began in it) and the diff.
_STATE = {
    "hunk_no": "int", "old_start": "bigint", "old_n": "bigint", "new_start": "bigint", "new_n": "bigint", "old": "bigint", "new": "bigint",
    "file_no": "int", "last": "string", "target": "string", "source": "string", "named": "string", "mode": "string",
    "any": "boolean", "path": "string", "added": "bigint", "removed": "bigint", "is_new": "boolean", "is_deleted": "boolean", "broken": "boolean", "own_old": "bigint", "own_new": "bigint", "own_head": "boolean",
    "error": "boolean", "files": f"array<{FILE}>", "bodies": f"array<{_BODY}>",
}


def _added(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_REMOVED - 1).cast("bigint"))


def _removed(c: Column) -> Column:
    return F.shiftright(c, 20).bitwiseAND(F.lit(_REMOVED - 1).cast("bigint"))


def _old(c: Column) -> Column:
    return _removed(c) + F.shiftright(c, 40)


def _new(c: Column) -> Column:
    return _added(c) + F.shiftright(c, 40)


def _state(now: Column | None = None, **fields: Column) -> Column:
    """A state of the fold: fields as given, else as they are now, else as they are before a diff's first line."""
    zero = {"int": F.lit(0), "bigint": F.lit(0), "boolean": F.lit(False)}
    kept = {c: fields[c] if c in fields else now[c] if now is not None else zero.get(kind, F.array() if kind.startswith("array") else F.lit(None)) for c, kind in _STATE.items()}
    return F.struct(*[v.cast(_STATE[c]).alias(c) if c not in ("files", "bodies") or now is None else v.alias(c) for c, v in kept.items()])


def _facts(raw: Column, after: Column) -> Column:
    """What a line says by itself; `after` is the next line."""
    head = raw.startswith("@@") & raw.rlike(_HUNK)
    number = lambda i, default: F.when(head, F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(raw, _HUNK, i), F.lit("")), F.lit("999999999")).cast("long"), F.lit(default)))
    plain = lambda c: F.nullif(F.regexp_replace(c, '^"|"$', ""), F.lit(""))
    header = lambda start, pattern, i=1: F.when(raw.startswith(start), plain(F.regexp_extract(raw, pattern, i)))
    named = F.coalesce(header("rename to ", "^rename to (.*)$"), header("copy to ", "^copy to (.*)$"), header("diff --git ", r'^diff --git "?a/(.*?)"? "?b/\1"?$'), header("diff --git ", r'^diff --git .* "?b/(.*?)"?$'), header("diff --git ", r"^diff --git \S+ (\S+)$"))
    pair = raw.startswith("--- ") & F.coalesce(after.startswith("+++ "), F.lit(False))
    return F.struct(
        raw.startswith("@@").alias("at"), head.alias("head"), number(1, 0).alias("old_start"), number(2, 1).alias("old_n"), number(3, 0).alias("new_start"), number(4, 1).alias("new_n"),
        raw.startswith("diff --git ").alias("git"), pair.alias("pair"), F.when(raw.startswith("+++ "), F.nullif(F.regexp_extract(raw, r"^\+\+\+ (?:b/)?([^\t]*)", 1), F.lit(""))).alias("target"),
        F.when(pair, F.regexp_extract(raw, r"^--- (?:a/)?([^\t]*)", 1)).alias("source"), named.alias("named"), F.coalesce(header("new file mode ", "^(new)"), header("deleted file mode ", "^(deleted)")).alias("mode"),
    )


def _path(s: Column) -> Column:
    return F.coalesce(F.when(s["target"] == "/dev/null", s["source"]).otherwise(s["target"]), s["named"])


def _is(s: Column, name: str, mode: str) -> Column:
    return F.coalesce(s[name] == "/dev/null", F.lit(False)) | F.coalesce(s["mode"] == mode, F.lit(False))


def _short(s: Column) -> Column:
    """Whether the hunk at hand began in this file and hasn't the lines here that its header counts."""
    return s["own_head"] & ((s["own_old"] != s["old_n"]) | (s["own_new"] != s["new_n"]))


def _short_hunk(s: Column) -> Column:
    return (s["hunk_no"] > 0) & ((s["old"] != s["old_n"]) | (s["new"] != s["new_n"]))


def _with_file(s: Column) -> Column:
    """The files so far and the one at hand, if any of its lines count."""
    own = F.struct(s["file_no"].alias("file_no"), s["path"].alias("path"), s["added"].alias("added"), s["removed"].alias("removed"), s["is_new"].alias("is_new"), s["is_deleted"].alias("is_deleted"), (s["broken"] | _short(s)).alias("broken"))
    return F.when(s["any"], F.array_append(s["files"], own)).otherwise(s["files"])


def _step(s: Column, p: Column) -> Column:
    """The state after a piece: its first line, of which p has the facts, and the plain lines after it."""
    f = p["f"]
    body = (s["hunk_no"] > 0) & ~f["head"] & ((s["old"] < s["old_n"]) | (s["new"] < s["new_n"])) & (p["marks"] > 0)

    def headed(b: Column) -> Column:
        """The state after what the line says of hunks and files; b: whether it is a body line, and whether it starts a file."""
        git, pair = ~b["body"] & f["git"], ~b["body"] & f["pair"]
        fresh = b["first"]
        said = lambda name: F.coalesce(F.when(~b["body"], f[name]), F.when(~fresh, s[name]))
        zero = lambda name, new=fresh: F.when(new, 0).otherwise(s[name])
        no = lambda name, new=fresh: s[name] & ~new
        new_hunk = f["head"]
        hunk = {c: F.when(new_hunk, f[c]).otherwise(s[c]) for c in ("old_start", "old_n", "new_start", "new_n")}
        return _state(
            s, **hunk, hunk_no=s["hunk_no"] + new_hunk.cast("int"), old=zero("old", new_hunk), new=zero("new", new_hunk), file_no=s["file_no"] + fresh.cast("int"), last=F.when(git, "git").when(pair, "pair").otherwise(s["last"]),
            target=said("target"), source=said("source"), named=said("named"), mode=said("mode"),
            any=no("any"), path=F.when(~fresh, s["path"]), added=zero("added"), removed=zero("removed"), is_new=no("is_new"), is_deleted=no("is_deleted"), broken=(s["broken"] | (new_hunk & _short(s))) & ~fresh,
            own_old=zero("own_old", fresh | new_hunk), own_new=zero("own_new", fresh | new_hunk), own_head=new_hunk | no("own_head"),
            error=s["error"] | (new_hunk & _short_hunk(s)) | (f["at"] & ~new_hunk & ~b["body"]), files=F.when(fresh, _with_file(s)).otherwise(s["files"]),
        )

    def rest(b: Column, t: Column) -> Column:
        """The counts of the piece's body lines: its marked lines up to the end of the hunk. A first line that is none of them
        doesn't count."""
        base = F.when(b["body"], F.lit(0).cast("bigint")).otherwise(p["marks"])
        open_ = (t["hunk_no"] > 0) & ((t["old"] < t["old_n"]) | (t["new"] < t["new_n"]))
        done = lambda c: (t["old"] + _old(c - base) >= t["old_n"]) & (t["new"] + _new(c - base) >= t["new_n"])
        last = F.element_at(p["counts"], -1)
        end = F.when(done(last), F.get(F.filter(p["counts"], lambda c: (c >= base) & done(c)), 0)).otherwise(last)
        return F.struct(base.alias("base"), F.when(open_, end - base).otherwise(F.lit(0).cast("bigint")).alias("c"))

    def counted(b: Column, t: Column, r: Column) -> Column:
        """The state with the lines' own share: their sides, their file and, in a hunk's body, where they are; r: their counts."""
        path, is_new, is_deleted, c = _path(t), _is(t, "source", "new"), _is(t, "target", "deleted"), r["c"]
        own = F.struct(
            p["no"].alias("no"), F.when(b["body"], 0).otherwise(1).alias("first"), r["base"].alias("base"), c.alias("c"), t["file_no"].alias("file_no"), path.alias("path"), t["hunk_no"].alias("hunk_no"),
            (t["old_start"] + t["old"]).alias("at_old"), (t["new_start"] + t["new"]).alias("at_new"), is_new.alias("is_new"), is_deleted.alias("is_deleted"),
        )
        counts = (c > 0) | f["head"] | (t["file_no"] > 0)
        return _state(
            t, any=t["any"] | counts, path=F.when(counts, path).otherwise(t["path"]), added=t["added"] + _added(c), removed=t["removed"] + _removed(c), is_new=t["is_new"] | (counts & is_new), is_deleted=t["is_deleted"] | (counts & is_deleted),
            broken=t["broken"] | ((t["file_no"] > 0) & f["at"] & ~f["head"]), old=t["old"] + _old(c), new=t["new"] + _new(c), own_old=t["own_old"] + _old(c), own_new=t["own_new"] + _new(c),
            bodies=F.when(c > 0, F.array_append(t["bodies"], own)).otherwise(t["bodies"]),
        )

    starts = lambda is_body: ~is_body & (f["git"] | (f["pair"] & F.coalesce(s["last"] != "git", F.lit(True))))
    return let(F.struct(body.alias("body")), lambda a: let(F.struct(a["body"].alias("body"), starts(a["body"]).alias("first")), lambda b: let(headed(b), lambda t: let(rest(b, t), lambda r: counted(b, t, r)))))


def _pieces(raws: Column) -> Column:
    """The lines in pieces: a line that may be a header, or the CHUNKth plain one, and the plain lines after it. counts has
    those of the marks before each line and after the last."""
    mark = lambda raw: let(F.substring(raw, 1, 1), lambda m: F.when(m == "+", F.lit(_ADDED).cast("bigint")).when(m == "-", F.lit(_REMOVED).cast("bigint")).when(m.isin(" ", ""), F.lit(_CONTEXT)).otherwise(F.lit(0).cast("bigint")))
    starts = F.filter(F.sequence(F.lit(0), F.size(raws) - 1), lambda i: (i % CHUNK == 0) | F.substring(F.get(raws, i), 1, 20).rlike(_MARKER))
    counts = lambda own: F.aggregate(own, F.array(F.lit(0).cast("bigint")), lambda a, raw: F.array_append(a, F.element_at(a, -1) + mark(raw)))

    def piece(i: Column, no: Column, ends: Column) -> Column:
        own = F.slice(raws, i + 1, F.coalesce(F.get(ends, no + 1), F.size(raws)) - i)
        return F.struct(no.alias("no"), i.alias("start"), _facts(F.get(raws, i), F.get(raws, i + 1)).alias("f"), mark(F.get(raws, i)).alias("marks"), counts(own).alias("counts"))

    return let(starts, lambda ends: F.transform(ends, lambda i, no: piece(i, no, ends)))


def _body_lines(raws: Column, p: Column, b: Column) -> Column:
    """The lines (of LINE) that a piece has in a hunk's body."""
    before, after = (lambda j: F.get(p["counts"], j)), (lambda j: F.get(p["counts"], j + 1))

    def line(j: Column) -> Column:
        step, c = after(j) - before(j), before(j) - b["base"]
        kind = F.when(step == _ADDED, "add").when(step == _REMOVED, "remove").otherwise("context")
        at_old, at_new, raw = (b["at_old"] + _old(c)).cast("int"), (b["at_new"] + _new(c)).cast("int"), F.get(raws, p["start"] + j)
        return F.struct(
            b["file_no"].alias("file_no"), b["path"].alias("path"), b["hunk_no"].alias("hunk_no"), (p["start"] + j).alias("ord"), kind.alias("type"), F.substring(raw, F.lit(2), F.length(raw)).alias("content"),
            F.when(step == _REMOVED, at_old).otherwise(at_new).alias("line_number"), F.when(step == _CONTEXT, at_old).alias("other_line"), b["is_new"].alias("is_new"), b["is_deleted"].alias("is_deleted"),
        )

    lines = F.sequence(b["first"], F.size(p["counts"]) - 2)
    return F.transform(F.filter(lines, lambda j: (after(j) > before(j)) & (after(j) - b["base"] <= b["c"])), line)


def parsed(diff: Column) -> Column:
    """A diff as a struct: lines (of LINE), files (of FILE), and error: a hunk is shorter than its header says, or a hunk header
    doesn't parse. Null for a null diff.

    A hunk's body lasts until its header's counts are used up, so a removed line that looks like a file header is one.
    A file starts at its "diff --git" line, or at a pair of --- and +++ that follows none; what a header says holds to the
    end of its own file. Files without lines (renamed, binary, empty) count, too.
    """

    def fold(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
        zero = F.struct(_state().alias("s"), F.array().cast(f"array<array<{_BODY}>>").alias("out"))
        emptied = lambda s: _state(s, bodies=F.array().cast(f"array<{_BODY}>"))

        def step(a: Column, no: Column) -> Column:
            done = F.aggregate(F.slice(pieces, no * CHUNK + 1, F.lit(CHUNK)), a["s"], _step)
            return let(done, lambda s: F.struct(emptied(s).alias("s"), F.array_append(a["out"], s["bodies"]).alias("out")))

        return F.aggregate(numbers, zero, step, lambda a: F.struct(F.flatten(a["out"]).alias("bodies"), _with_file(a["s"]).alias("files"), (a["s"]["error"] | _short_hunk(a["s"])).alias("error")))

    def result(raws: Column, pieces: Column, r: Column) -> Column:
        each = F.transform(r["bodies"], lambda b: _body_lines(raws, F.get(pieces, b["no"]), b))
        return F.struct(F.flatten(each).alias("lines"), r["files"].alias("files"), r["error"].alias("error"))

    return F.when(diff.isNotNull(), let(F.split(diff, "\n"), lambda raws: let(_pieces(raws), lambda pieces: let(fold(pieces), lambda r: result(raws, pieces, r)))))


def diff_lines(changes: DataFrame) -> DataFrame:
    """change_id, diff -> change_id, file_no, path, hunk_no, ord, type (add, remove, context), content, line_number,
    other_line, is_new, is_deleted. Numbers are those of the new side, of the old side for removed lines; other_line is a
    context line's number on the old side, null for the rest. is_new and is_deleted go by the paths of a file's headers, or
    by its mode."""
    return changes.select("change_id", F.explode(parsed(F.col("diff"))["lines"]).alias("_l")).select("change_id", "_l.*")


def parse_errors(changes: DataFrame) -> DataFrame:
    """change_id of the diffs in which a hunk is shorter than its header says, or a hunk header doesn't parse."""
    return changes.where(parsed(F.col("diff"))["error"]).select("change_id").distinct()


def marks(diff: Column) -> Column:
    """A diff's files_changed, lines_added and lines_removed by the marks of its lines alone."""
    n = lambda lines, p, but: F.size(F.filter(lines, lambda x: x.startswith(p) & ~x.startswith(but))).cast("long")
    counts = lambda x: F.struct(n(x, "diff --git", "\n").alias("files_changed"), n(x, "+", "+++").alias("lines_added"), n(x, "-", "---").alias("lines_removed"))
    return let(F.split(diff, "\n"), counts)


def fallback_totals(changes: DataFrame) -> DataFrame:
    """Totals of diffs that don't parse, by the marks of their lines alone."""
    return changes.select("change_id", marks(F.col("diff")).alias("_m")).select("change_id", "_m.*")


def file_changes(lines: DataFrame) -> DataFrame:
    """One row for each file of a change that has lines; changed_files has those without, too."""
    return lines.groupBy("change_id", "file_no").agg(F.first("path").alias("path"), F.count_if(F.col("type") == "add").alias("added"), F.count_if(F.col("type") == "remove").alias("removed"), F.bool_or("is_new").alias("is_new"), F.bool_or("is_deleted").alias("is_deleted"))


def changed_files(changes: DataFrame) -> DataFrame:
    """One row for each file of a diff, by its header or its lines: renamed, binary and empty files have no lines.

    Columns are those of file_changes, and broken: a hunk of the file is what parse_errors looks for. A hunk lies in one
    file; the lines after its end may be headers of the next.
    """
    return changes.select("change_id", F.explode(parsed(F.col("diff"))["files"]).alias("_f")).select("change_id", "_f.*")


def change_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("change_id").agg(F.count("*").alias("files_changed"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"))


def diff_hash(diff: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(diff, 256))


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot; empty without one, and for a name that only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def lane(path: Column) -> Column:
    """pdf, sheet or image by extension, null for code."""
    out = None
    for name, ends in LANES.items():
        out = F.when(suffix(path).isin(*ends), name) if out is None else out.when(suffix(path).isin(*ends), name)
    return out


def is_doc(path: Column) -> Column:
    return path.rlike("(?i)" + DOC_FILE)


def is_config(path: Column) -> Column:
    return path.rlike("(?i)" + CONFIG_FILE)


def is_test(path: Column) -> Column:
    return any_match(path, PATHS["L1"])


def topic_text(path: Column, content: Column) -> Column:
    """The code in a line: null in a config file, empty for a comment line, else without a trailing comment."""
    end = suffix(path)
    out = F.when(is_config(path), F.lit(None).cast("string"))
    for mark, ends in COMMENT_MARKERS.items():
        own = F.when(content.rlike(rf"(?U)^\s*\Q{mark}\E"), "").otherwise(F.regexp_replace(content, rf"(?Ud)\s\Q{mark}\E.*$", ""))
        out = out.when(end.isin(*ends), F.when(content.contains(mark), own).otherwise(content))
    return out.otherwise(content)


def reverse_lines(lines: DataFrame) -> DataFrame:
    """The lines of the change that takes this one back: kinds and sides change places. An added line's number on the new
    side is the removed line's on the old one, and a context line's two numbers are exchanged."""
    kind = F.when(F.col("type") == "add", "remove").when(F.col("type") == "remove", "add").otherwise("context")
    swapped = {"type": kind, "line_number": F.coalesce("other_line", "line_number"), "other_line": F.when(F.col("type") == "context", F.col("line_number"))}
    return lines.withColumns(swapped | {"is_new": F.col("is_deleted"), "is_deleted": F.col("is_new")})
