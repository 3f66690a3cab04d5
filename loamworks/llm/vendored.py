"""Files nobody in the repository wrote by hand: generated, minified, vendored, and data saved as code.

Vendored code is found by content. Merkle hashes are computed bottom-up over the directory trees of all repositories: a
leaf is the hash of a file's text, comments and white space aside, and a directory the hash of its children's hashes, names
aside. A subtree that occurs in repositories of different owners is third-party code, whatever it is called. Repositories
count as one owner's if they share a file at the same path outside of directories for third-party code. Known library
files are one more owner; copies of them that were adapted are found by shingles of five words, of which a copy
holds at least 0.8 of the library file's. Generated files, minified scripts and data are caught by rules on path, header
and layout, which read the whole text.

Defined results: ``.md`` and ``.txt`` files, and files without path or text, are no cases, but lock files count by their
name; a repeated row is flagged again; null repositories are unrelated to all others and join no subtree; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship

#: Words of a shingle, and the share of a library file's shingles that an adapted copy holds.
SHINGLE, SIMILARITY = 5, 0.8
#: A file of fewer words is too common to tell where it comes from.
LEAST_WORDS = 40
#: Library text that is held by every task; beyond it, shingles are joined by a shuffle.
LIBRARY_LIMIT = 32 << 20

# Directories for third-party code and for output of tools, marks in file names.
VENDOR_DIRS = frozenset("vendor vendored third_party thirdparty third-party 3rdparty 3rd_party godeps deps bower_components node_modules jspm_packages external externals extern carthage pods site-packages".split())
GENERATED_DIRS = frozenset("generated __generated__ autogen autogenerated gen generated-sources generated_sources".split())
_GENERATED_NAME = re.compile(r".[._-](?:pb|pb2|pb2_grpc|grpc|g|gen|auto|autogen|generated|designer)\.[a-z]+\Z", re.I)
_LOCK_NAME = re.compile(r"(?:\A|[._-])lock\.[a-z]+\Z|\.lock\Z|\A(?:npm-shrinkwrap\.json|go\.sum|resolved\.json)\Z", re.I)
_MINIFIED_NAME = re.compile(r"[._-]min\.(?:js|mjs|cjs|css)\Z", re.I)

# What tools write at the top of their output.
_TOOL = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto-?generated\b(?! (?:by hand|ids))|\bautomatically (?:generated|created|produced|written)\b"
    r"|\b(?:code|file|this (?:file|code|module|class)(?: (?:was|is|has been))?) generated\b|\A(?:generated|created|produced|built) (?:by|from|with|using)\b|\b(?:was|is|been) (?:generated|produced|created|built) (?:by|from|with) "
    r"|\b(?:please )?do not (?:edit|modify|change)(?: (?:it|this(?: file)?|by hand|manually|directly))*\s*(?:[.!;:]|\Z)|\bmanual (?:edits|changes) (?:are|will|get)\b|\b(?:changes|edits) (?:will be|are|get) (?:lost|overwritten)\b"
    r"|\bmachine(?:-| )(?:generated|output)\b|\bregenerate with\b|\Asource: .* compiler: |\A-\*- .*\boutput\b"
    r"|\bautomatisch [^.]{0,60}(?:erzeugt|erstellt|generiert)|\bnicht (?:bearbeiten|ändern)\b|\b(?:produit|généré|créé) (?:automatiquement )?par\b|\bne pas (?:modifier|éditer)\b"
    r"|\bgenerado (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|\bgerado (?:automaticamente|por)\b|\bgenerato (?:automaticamente|da)\b|\bnon modificare\b|自动生成|自動生成|请勿(?:修改|编辑)|編集しないで|сгенерирован|не (?:редактир|изменя)",
    re.I,
)
_NO_TOOL = re.compile(r"\b(?:not|never|hand-?) ?(?:auto-?)?generated\b|\bwe do(?: not|n't)\b|\bids (?:are|is) generated\b|\bgenerated by the \w+, never\b", re.I)
_COMMENT_LINE = re.compile(r"(?://+!?|#+!?|/\*+!?|\*+(?!/)|<!--|--+|;+|\"\"\"|''')[ \t]?(.*?)(?:\*+/|-->|\"\"\"|''')?[ \t]*\Z")
_CODE = frozenset((".py", ".ts", ".tsx", ".js", ".mjs", ".cjs", ".jsx", ".go", ".java", ".kt", ".rs", ".c", ".h", ".cc", ".cpp", ".cs", ".rb", ".php", ".swift", ".css"))
_TEXT = frozenset((".md", ".mdx", ".txt", ".rst"))
#: Words of code that does something; a file that only holds data has none outside of literals.
_STATEMENT = re.compile(r"\b(?:def|function|func|return|if|for|while|switch|lambda|import|raise|throw|new|print\w*)\b|=>")
#: The data has a name or is exported: plain JSON under another extension is a misplaced file.
_NAMED = re.compile(r"=|\bexport\b|\breturn\b")
_LOCK = re.compile(r'"lock(?:file)?Version"\s*:|"_meta"\s*:\s*\{\s*"hash"')
_LOCKED = re.compile(r'"(?:integrity|checksum|resolved|hash(?:es)?|sha(?:1|256|512))"\s*:')
_EQUALS = re.compile(r"\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'")
_ANY_WORD = re.compile(r"\w+")
_STRIPPED = re.compile(r"(\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|`[^`]*`)|//[^\r\n]*|/\*.*?\*/|^[ \t]*#[^\r\n]*", re.S | re.M)
_LITERAL = re.compile(r"\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|`[^`]*`|(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]?(?![\w])")
_WORD = re.compile(r"[^\W\d]\w*")


def header(body: str) -> list[str]:
    """The comment lines before the first line of code."""
    out = []
    for line in body.lstrip("﻿").splitlines():
        line = line.strip()
        if not line:
            continue
        m = _COMMENT_LINE.match(line)
        if m is None or (line[0] == "#" and line[:2] == "#[" ):
            break
        out.append(m[1].strip())
    return out


def generated_header(body: str) -> bool:
    """Does a tool say at the top that it wrote the file?"""
    return any(_TOOL.search(x) and not _NO_TOOL.search(x) for x in header(body))


def without_comments(body: str) -> str:
    """The text without comments; what looks like one inside of a literal stays."""
    return _STRIPPED.sub(r"\1", body)


def minified(body: str) -> bool:
    """Most of the text stands on long lines with hardly any white space between tokens outside of literals."""
    lines = body.splitlines()
    long = [x for x in lines if len(x) > 200]
    if 2 * sum(map(len, long)) < len(body):
        return False
    code = _LITERAL.sub("0", without_comments("\n".join(long)))
    return len(code) > 150 and len(code) - len("".join(code.split())) < 0.12 * len(code) and len(_WORD.findall(code)) > 0.08 * len(code)


def data_block(code: str) -> bool:
    """Code without comments that is nothing but a long list of literals."""
    if code.count("=") + code.count("(") > 40 and _EQUALS.sub("", code).count("=") > 40:
        return False
    shape, n = _LITERAL.subn("", code)
    dense = len("".join(code.split()))
    left = len(re.sub(r"[\s,+\\]", "", shape))
    return bool(dense > 400 and n and left < 0.15 * dense and len(_WORD.findall(shape)) <= 40 and _NAMED.search(shape) and not _STATEMENT.search(shape))


#: What an outer declaration names, in the languages of ``_CODE``; a member may be indented by one step.
_DECLARED = re.compile(
    r"^(?:(?:export |default |async |declare )*(?:function\*?|def|class|const|let|var|func(?: \([^)\n]*\))?) (\w+)|(\w+)(?: ?:[^=\n]+)? = |"
    r"(?: {2,4}|\t)(?:(?:public|private|protected|static|final|readonly) )+[\w<>\[\], ]*?(\w+)\s*[(=;]|\t([A-Z]\w*) [\w\[\]*.]+ *`)",
    re.M,
)
_ORDINAL = re.compile(r"(?<!\d)(\d+)_?\Z")


def numbered(code: str) -> bool:
    """Of code without comments: nearly all declarations are members numbered from 0 on without a gap."""
    names = [next(filter(None, x)) for x in _DECLARED.findall(code)]
    numbers = [int(m[1]) for m in map(_ORDINAL.search, names) if m]
    found = set(numbers)
    return len(numbers) >= 4 and len(numbers) >= 0.75 * len(names) and len(found) >= 4 and found == set(range(len(found)))


def rule(path: str, body: str | None, code: str) -> str | None:
    """The rule on path, header or layout that says that nobody wrote the file by hand, or None; ``code`` is the text without comments."""
    *dirs, name = path.split("/")
    ext = "." + name.rpartition(".")[2].lower() if "." in name else ""
    if ext in _TEXT:
        return None
    if _LOCK_NAME.search(name):
        return "lock"
    folders = {d.lower() for d in dirs}
    if folders & VENDOR_DIRS:
        return "vendor directory"
    if not body or not body.strip():
        return None
    if folders & GENERATED_DIRS or (ext in _CODE and _GENERATED_NAME.search(name)):
        return "generated name"
    if ext == ".json" and _LOCK.search(body) and _LOCKED.search(body):
        return "lock"
    if ext in _CODE:
        if generated_header(body):
            return "generated header"
        if numbered(code):
            return "numbered members"
        if _MINIFIED_NAME.search(name) or minified(body):
            return "minified"
        if data_block(code):
            return "data"
    return None


def words_of(code: str) -> list[str]:
    return _ANY_WORD.findall(code)


def leaf(code: str) -> bytes:
    """Hash of a text without its white space."""
    return hashlib.blake2b("".join(code.split()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``SHINGLE`` ids, distinct; runs with an unknown word (id 0) are left out."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        part = ids[k : k + n]
        known &= part != 0
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h[known])


class Library:
    """Shingles of the known library files."""

    def __init__(self, bodies: list[str]) -> None:
        texts = [words_of(without_comments(b)) for b in bodies]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        sets = [_mix(np.fromiter((self.ids[w] for w in t), np.uint64, len(t))) for t in texts]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], owner[order]

    def contained(self, words: list[str]) -> bool:
        """Does the text hold at least ``SIMILARITY`` of the shingles of some library file?"""
        if not len(self.hashes) or not words:
            return False
        get = self.ids.get
        h = _mix(np.fromiter((get(w, 0) for w in words), np.uint64, len(words)))
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        low, count = low[high > low], (high - low)[high > low]
        if not len(low):
            return False
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        held = np.bincount(self.owner[at], minlength=len(self.sizes))
        return bool(((held >= SIMILARITY * self.sizes) & (self.sizes >= LEAST_WORDS)).any())


_MARKED = pa.schema([("file_id", pa.int64()), ("repository", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("leaf", pa.binary()), ("n_words", pa.int32())])
_MARKED_DDL = "file_id long, repository string, path string, rule string, leaf binary, n_words int"
_HELD: dict[int, Library] = {}


def _canonical(path: str) -> str:
    return re.sub(r"^(?:\./)+", "", re.sub(r"[\\/]+", "/", path))


def _mark(held: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = None
        if held is not None:
            # Built once per worker.
            bodies = held.value
            key = hash(tuple(bodies))
            if key not in _HELD:
                _HELD.clear()
                _HELD[key] = Library(bodies)
            library = _HELD[key]
        for batch in batches:
            rows = []
            for i, repo, path, body in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                body, path = body.as_py(), _canonical(path)
                code = without_comments(body) if body and "." + path.rpartition(".")[2].lower() not in _TEXT else ""
                found = rule(path, body, code)
                words = words_of(code)
                long = len(words) >= LEAST_WORDS
                if found is None and long and library is not None and library.contained(words):
                    found = "library copy"
                rows.append((i, repo, path, found, leaf(code) if long else None, len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _MARKED, strict=True)], schema=_MARKED)

    return run


def _bodies(files: DataFrame) -> DataFrame:
    return files.where("body is not null and length(body) > 0").select("body").distinct()


def marked_files(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """(file_id, repository, path, rule, leaf, n_words) of every file with a path; one pass over the texts."""
    spark = source_files.sparkSession
    ship(spark)
    known = _bodies(upstream_files)
    size = known.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    files = source_files.where("path is not null").select(F.col("file_id").cast("long").alias("file_id"), "repository", "path", "body")
    if size <= LIBRARY_LIMIT:
        return files.mapInArrow(_mark(spark.sparkContext.broadcast(sorted(r.body for r in known.collect()))), _MARKED_DDL)
    return files.mapInArrow(_mark(None), _MARKED_DDL)


def library_copies(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """(file_id) of files that hold at least ``SIMILARITY`` of a library file's shingles, by a shuffle: for libraries of any size.

    Shingles that several library files share are joined once and counted for each of them after the join.
    """
    shingles = lambda df, key: df.where("body is not null").select(key, "body").mapInArrow(_shingled, "id long, shingle long, n_shingles int")
    lib = materialise(shingles(upstream_files.withColumn("lib_id", F.col("lib_id").cast("long")), "lib_id").select(F.col("id").alias("lib_id"), "shingle", "n_shingles").where(F.col("n_shingles") >= LEAST_WORDS).distinct(), "library")
    texts = shingles(source_files.withColumn("file_id", F.col("file_id").cast("long")), "file_id").select(F.col("id").alias("file_id"), "shingle")
    held = texts.join(lib, "shingle").groupBy("file_id", "lib_id").agg(F.count_distinct("shingle").alias("held"), F.first("n_shingles").alias("n_shingles"))
    return held.where(F.col("held") >= SIMILARITY * F.col("n_shingles")).select("file_id").distinct()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(without_comments(body.as_py()))
            ids = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()) | 1 for w in words), np.uint64, len(words))
            h = _mix(ids)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array([len(h)] * len(h), pa.int32())], names=["id", "shingle", "n_shingles"])


def subtrees(leaves: DataFrame) -> DataFrame:
    """Merkle hashes bottom-up: (repository, path, hash, depth) of all files and directories with the texts that are long enough.

    ``leaves``: distinct (repository, path, leaf). A directory's hash is that of its children's, sorted, without names; a
    directory of one child is that child under another name. Each level is one grouping with pre-aggregation; the number of levels
    is that of the deepest path.
    """
    nodes = leaves.select("repository", "path", F.col("leaf").alias("hash"), (F.size(F.split("path", "/")) - 1).alias("depth"))
    nodes = materialise(nodes, "leaves")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done, level = [nodes], nodes.where(F.col("depth") == deepest) if deepest else None
    parent = F.regexp_replace("path", "/[^/]*$", "")
    for depth in range(deepest, 0, -1):
        up = level.groupBy("repository", parent.alias("path")).agg(F.sort_array(F.collect_list("hash")).alias("hashes"))
        up = up.select("repository", "path", F.when(F.size("hashes") == 1, F.col("hashes")[0]).otherwise(F.unhex(F.md5(F.array_join(F.transform("hashes", F.hex), "")))).alias("hash"), F.lit(depth - 1).alias("depth"))
        # Cut the lineage now and then: deep trees would make it long.
        up = materialise(up, "directories")
        done.append(up)
        level = nodes.where(F.col("depth") == depth - 1).unionByName(up)
    return reduce(DataFrame.unionByName, done)


def owners(marked: DataFrame) -> DataFrame:
    """(repository, owner): repositories that share a file at one path, outside of directories for third-party code, have one owner.

    Connected components by the least name: each round passes names through the shared files; it ends when none changes.
    """
    shared = marked.where("repository is not null and leaf is not null and not coalesce(rule = 'vendor directory' or rule = 'library copy', false)").select("repository", F.xxhash64("path", "leaf").alias("file")).distinct()
    links = shared.join(shared.groupBy("file").count().where("count > 1"), "file", "left_semi")
    links = materialise(links, "links")
    names = marked.where("repository is not null").select("repository").distinct().select("repository", F.col("repository").alias("owner"))
    names = materialise(names, "owners")
    while True:
        least = links.join(names, "repository").groupBy("file").agg(F.min("owner").alias("owner"))
        best = links.join(least, "file").groupBy("repository").agg(F.min("owner").alias("least"))
        after = materialise(names.join(best, "repository", "left").select("repository", F.least("owner", F.coalesce("least", "owner")).alias("owner"), F.col("owner").alias("before")), "owners")
        changed = after.where("owner != before").isEmpty()
        names = after.select("repository", "owner")
        if changed:
            return names


def shared_files(marked: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """(repository, path) of files in subtrees that repositories of different owners share, or that a library shares."""
    leaves = marked.where("leaf is not null and repository is not null").select("repository", "path", "leaf").distinct()
    known = upstream_files.where("body is not null").select(F.lit(None).cast("long").alias("file_id"), F.concat(F.lit("\0"), F.coalesce("library", F.lit(""))).alias("repository"), F.lit("x").alias("path"), "body")
    library = known.mapInArrow(_mark(None), _MARKED_DDL).where("leaf is not null").select(F.col("repository").alias("owner"), F.col("leaf").alias("hash"))
    trees = subtrees(leaves)
    # A hash held by a third of all rows is one row per owner before the shuffle by hash.
    held = trees.join(owners(marked), "repository").select("owner", "hash").unionByName(library).distinct()
    common = materialise(held.groupBy("hash").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a != b").select("hash"), "common")
    roots = materialise(trees.join(common, "hash", "left_semi").select("repository", "path").distinct(), "roots")
    # Each file asks for itself and all its directories.
    parts = F.split("path", "/")
    above = leaves.select("repository", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return above.join(roots.withColumnRenamed("path", "root"), ["repository", "root"], "left_semi").select("repository", "path").distinct()


def not_by_hand(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """(file_id, repository, path, reason) of every file that nobody in its repository wrote by hand."""
    marked = materialise(marked_files(source_files, upstream_files), "marked")
    shared = shared_files(marked, upstream_files).withColumn("shared", F.lit("shared subtree"))
    out = marked.join(shared, ["repository", "path"], "left")
    reason = F.coalesce("rule", "shared")
    size = _bodies(upstream_files).agg(F.sum(F.octet_length("body"))).first()[0] or 0
    if size > LIBRARY_LIMIT:
        out = out.join(library_copies(source_files, upstream_files).withColumn("copy", F.lit("library copy")), "file_id", "left")
        reason = F.coalesce("rule", "copy", "shared")
    return out.select("file_id", "repository", "path", reason.alias("reason")).where("reason is not null")
