"""Path algebra and scalar helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column | str) -> Column:
    """Empty for a path at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def depth(path: Column | str) -> Column:
    return F.size(F.split(path, "/"))


def join(*parts: Column | str) -> Column:
    """Parts with one slash between; empty parts are left out."""
    return F.concat_ws("/", *(F.when(F.length(p) > 0, p) for p in map(_col, parts)))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ancestors(path: Column | str) -> Column:
    """All directories above a path, the topmost first."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def clean(path: Column | str) -> Column:
    """Slashes for back-slashes, no empty or `.` parts, `..` taken with the part before; one that would leave the root is dropped."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, p: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def under(path: Column | str, prefix: Column | str) -> Column:
    """Whether a path is the prefix or below it; the empty prefix covers all."""
    path, prefix = _col(path), _col(prefix)
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def remap(path: Column | str, mount: str, target: str) -> Column:
    """A path under a mount with the mount replaced; others stay."""
    path = _col(path)
    rest = F.substr(path, F.lit(len(mount) + 2))
    return F.when(path == mount, F.lit(target)).when(F.startswith(path, F.lit(mount + "/")), join(F.lit(target), rest)).otherwise(path)


def hash_bucket(digest: Column | str, bits: int = 6) -> Column:
    """The leading bits of the second byte of a hex digest: the index bucket of an address."""
    return F.shiftright(F.conv(F.substr(digest, F.lit(3), F.lit(2)), 16, 10).cast("int"), 8 - bits)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob on lower-case paths: ** crosses directories, * and ? don't, classes as they are."""
    out, i, glob = "", 0, glob.lower()
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


#: Letters of the actions, as a change list is printed.
CODES = {"keep": "M", "add": "A", "delete": "D", "move": "V", "copy": "C"}


def action_code(action: Column | str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair)), _col(action))


#: Bits of a node's flags, in the order in which an action is read from them.
FLAGS = {"delete": 1, "add": 2, "move": 4, "copy": 8, "staged": 16, "dirty": 32, "merge": 64, "conflict": 128}


def flag_action(flags: Column | str) -> Column:
    flags = _col(flags)
    has = lambda f: flags.bitwiseAND(F.lit(FLAGS[f])) != 0
    return F.when(has("delete"), "delete").when(has("add"), "add").when(has("move"), "move").when(has("copy"), "copy").otherwise("keep")


def has_flag(flags: Column | str, flag: str) -> Column:
    return _col(flags).bitwiseAND(F.lit(FLAGS[flag])) != 0


def branch_name_ok(branch: Column | str) -> Column:
    """Neither empty nor over 1000 bytes, nor a non-zero id in hex digits."""
    branch = _col(branch)
    hex_id = branch.rlike("^[0-9a-fA-F]{32}$") & ~branch.rlike("^0{32}$")
    return (F.octet_length(branch).between(1, 1000)) & ~hex_id


def has_conflict_marker(text: Column | str) -> Column:
    return F.coalesce(F.regexp_like(_col(text), F.lit(r"(?m)^(<<<<<<< |>>>>>>> |[|]{7} )")), F.lit(False))


def salted(salt: str, function: str, *args: Column | str) -> Column:
    """The key of a function's result: a digest of salt, function and arguments."""
    return F.sha2(F.concat_ws("\x1f", F.lit(salt), F.lit(function), *(_col(a).cast("string") for a in args)), 256)


def decoded(raw: Column | str) -> Column:
    """Bytes as text: UTF-16 by its byte-order mark, else UTF-8 (a mark of it left out); null where they are neither."""
    raw = _col(raw)
    head = F.hex(F.substring(raw, 1, 3))
    rest = lambda n: F.substring(raw, n + 1, 2**31 - 1)
    wide = F.when(F.startswith(head, F.lit("FFFE")), F.decode(rest(2), "UTF-16LE")).when(F.startswith(head, F.lit("FEFF")), F.decode(rest(2), "UTF-16BE"))
    plain = F.when(head == "EFBBBF", rest(3)).otherwise(raw)
    return F.coalesce(wide, F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string")))


def stack_points(packed: Column | str) -> Column:
    """Branch points of a packed stack: records of a 16-byte branch and a 32-byte revision, as an array of (branch, revision) in hex."""
    packed = F.lower(F.hex(_col(packed)))
    many = F.floor(F.length(packed) / 96).cast("int")
    at = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    cut = lambda i, a, n: F.substr(packed, i * 96 + a, F.lit(n))
    return F.transform(at, lambda i: F.struct(cut(i, 1, 32).alias("branch"), cut(i, 33, 64).alias("revision")))


#: Fixed value: files of a block of a tree's index, as a power of two.
BLOCK_BITS = 10


def block_of(node: Column | str) -> tuple[Column, Column]:
    """(block, index within it) of a node's number."""
    return F.shiftright(_col(node), BLOCK_BITS), _col(node).bitwiseAND(F.lit(2**BLOCK_BITS - 1))


def url_parts(url: Column | str) -> Column:
    """A repository's address as (remote, name): the last part of the path is its name; null where there is no scheme or name."""
    url = F.rtrim(F.col(url) if isinstance(url, str) else url, F.lit("/"))
    remote = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+(?:/[^/]+)*)/[^/]+$", 1)
    return F.when(F.length(remote) > 0, F.struct(remote.alias("remote"), F.substring_index(url, "/", -1).alias("name")))


def wire(digest: Column | str) -> Column:
    """A digest's hex digits as bytes; F.hex turns them back."""
    return F.unhex(_col(digest))


def epoch_ms() -> Column:
    return F.unix_millis(F.current_timestamp())
