"""Files that were not written by hand: generated, minified, third-party, or data stored as code.

A random forest (Spark ML) judges every file by compression ratio, token entropy, identifier lengths, comment density and the like. It is trained on files
that notices label: header comments that name a generator, and folder and file names that tools use for their output; all of these are hidden from its features. Hand-written
examples are files with the owner's own notice, and tests.

Third-party code reads like hand-written code, and some generated files do too, so the forest cannot tell these (see the README for figures) and an exact check follows it: a file
that a header or a package folder calls generated or third-party counts, and so does a copy of a third-party file elsewhere, told by content. Each run of three lines is hashed, of every ``WINDOW``
neighbouring hashes the least is kept (so a copied stretch of ``WINDOW`` + 2 lines or more is never missed), and a file is a copy if ``COPY`` or more of its hashes stand in files
known to be third-party. Files meet the known hashes by a join with a salt: no pairs of files are made, and a stretch that a third of all files hold spreads over ``SALTS`` tasks.

Features come from one pass over whole files, as a map (``spread`` for small inputs), written to the shared folder without the sources.
The forest is fitted on at most about ``MAX_TRAINING`` labelled files, drawn by the hash of their id; scoring covers every file, in the JVM.

Defined cases: a null or blank source is no case. A null path counts as ''. Without labels of both kinds no forest is trained and
only notices decide. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.functions.globs import glob_regex
from lakesift.runtime import materialise, plan_bytes, spread

CONFIG_BYTES = 32 << 20
MAX_TRAINING = 100_000
SEED = 7
#: Some generated files read as if written by hand; they pull the forest up to about 0.75 for hand-written code that no notice names.
THRESHOLD = 0.78
WINDOW, SALTS, COPY = 6, 16, 0.8
#: Lines after the leading comments in which notices are looked for too (attributes, comments below a package line).
HEADER_LINES = 14

# How notices of generators, of libraries and of owners begin.
_LEAD = r"^[\s/*#;<!\"'-]*"
GENERATED = re.compile(
    rf"(?im){_LEAD}(?:code generated by|this (?:file|code) (?:was|is|has been) (?:automatically |auto-?|machine-?)?(?:generated|produced)|"
    r"<?auto-?generated(?:>| file| code| by)|@generated|machine-(?:made|generated)|generated (?:from|by|code)\b|\S+ v?[\d.]+ output, source:)|"
    r"^\s*\[?@?(?:[\w.]+\.)?Generated(?:Code)?\("
)
LIBRARY = re.compile(
    rf"(?im){_LEAD}(?:bundled copy of (\w+)|copied from (\w+) v?\d|vendored from (\w+)|@license (\w+) v?\d|this file is part of (\w+)\.|(\w+) v\d[\w.]*[ \t]*$)|"
    r"released under an? \w+ licen[cs]e|copyright (?:the )?(\w+) contributors"
)
OWN = re.compile(r"(?im)copyright \(c\) the [\w-]+ team|(?:maintained|edited|written) by hand|internal use only")
PACKAGE_DIRS = re.compile(
    r"(?:^|/)(?:third[_-]?party|vendors?|external|externals|node_modules|bower_components|jspm_packages|site-packages|dist-packages|upstream|pods|carthage|godeps)/(?:@[\w-]+/)?([a-z]\w*)(?:-\d[\w.]*)?(?:[/.-]|$)"
)
GENERATED_NAMES = re.compile(r"(?:^|/)(?:__generated__|generated-sources|generated|gen)/|_pb2(?:_grpc)?\.py$|\.pb\.go$|\.g\.cs$|\.designer\.cs$|(?:^|/)zz_generated[_.]")
MINIFIED_NAMES = re.compile(r"[.-](?:min|bundle|chunk)\.[a-z]+$|\.[0-9a-f]{8,}\.[a-z]+$")
DATA_DIRS = re.compile(r"(?:^|/)(?:data|assets|fonts|sprites)/[^/]+$")
TESTS = re.compile(r"(?:^|/)tests?/|\.(?:test|spec)\.\w+$|(?:^|/)test_[^/]+$|_test\.go$")

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\s\w]")
_COMMENT = re.compile(r"/\*.*?\*/|(?<![:\"'])//[^\n]*|(?m:^|(?<=\s))#(?![!\[])[^\n]*|\"\"\".*?\"\"\"", re.S)
_SOME_NOTICE = re.compile(r"(?i)generat|machine-made|output, source|bundled|copied|vendored|@license|part of| v\d|licen[cs]e|contributors")  # in every notice above
_SHAPE = re.compile(r"[A-Za-z_]\w*|\d+")
_DIGIT = re.compile(r"\d")
_HEAD_COMMENT = re.compile(r"\s*(?:/\*.*?\*/|(?:(?://|#)[^\n]*(?:\n|\Z)\s*)+|\"\"\".*?\"\"\")", re.S)

FEATURES = (
    "compression", "token_entropy", "identifier_length", "short_identifiers", "comment_density", "mean_line", "max_line", "digits",
    "blanks", "literals", "distinct_tokens", "repeated_shapes", "size", "tokens_per_line", "excluded",
)


def normal_path(path: str | None) -> str:
    """Lower case, ``/`` as separator, no leading ``./``."""
    return re.sub(r"^(?:\./)+", "", (path or "").replace("\\", "/").strip().lower())


def features(source: str, excluded: bool) -> list[float]:
    """What the forest sees of a file; leading comments and notice lines are taken out first."""
    text = _HEAD_COMMENT.sub("", source.lstrip("﻿"), count=1)
    if _SOME_NOTICE.search(text):
        text = "\n".join(line for line in text.split("\n") if not (GENERATED.match(line) or LIBRARY.match(line)))
    text = text.replace("\r", "")
    n = max(1, len(text))
    raw = text.encode("utf-8", "replace")
    code, spans = _COMMENT.subn(" ", text)
    comments = len(text) - len(code) + spans  # each comment left one blank
    tokens = _TOKEN.findall(code)
    counts = Counter(tokens)
    names = letters = short = literal = 0
    for t, c in counts.items():
        if t[0].isalpha() or t[0] in "_$":
            names, letters, short = names + c, letters + c * len(t), short + c * (len(t) <= 3)
        elif t[0] in "\"'" or t[0].isdigit():
            literal += c * len(t)
    total = max(1, len(tokens))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    lines = [line for line in text.split("\n") if line.strip()] or [""]
    shapes = {shape for line in _SHAPE.sub("i", text).split("\n") if (shape := line.strip())} or {""}
    return [
        len(zlib.compress(raw, 6)) / max(1, len(raw)),
        entropy / math.log2(total + 1),
        letters / max(1, names),
        short / max(1, names),
        comments / n,
        math.log1p(n / len(lines)),
        math.log1p(max(map(len, lines))),
        len(_DIGIT.findall(text)) / n,
        (len(text) - sum(map(len, text.split()))) / n,
        literal / n,
        len(counts) / total,
        1 - len(shapes) / len(lines),
        math.log1p(n),
        math.log1p(total / len(lines)),
        float(excluded),
    ]


def header(source: str) -> str:
    """All leading comments of a file, however long and many, and the lines right after them."""
    at = 1 if source.startswith("\ufeff") else 0
    while m := _HEAD_COMMENT.match(source, at):
        at = m.end()
    return source[:at] + "\n".join(source[at:].split("\n", HEADER_LINES)[:HEADER_LINES])


def notices(path: str, source: str) -> tuple[str | None, str | None, int | None]:
    """(what a notice says, library it names, training label) of a file."""
    head = header(source)
    package = PACKAGE_DIRS.search(path)
    library = LIBRARY.search(head)
    if package:
        return "third_party", package[1], None  # looks like hand-written code: no example for the forest
    if library:
        return "third_party", next((g for g in library.groups() if g), None), None
    if GENERATED.search(head):
        return "generated", None, 1
    if GENERATED_NAMES.search(path):
        return "generated", None, 1
    if OWN.search(head):
        return None, None, 0
    if MINIFIED_NAMES.search(path) or DATA_DIRS.search(path):
        return None, None, 1
    return None, None, 0 if TESTS.search(path) else None


def prints(source: str) -> list[int]:
    """Hashes of runs of three lines (white space as one blank, empty lines and leading comments left out; none in a text of fewer lines), of each ``WINDOW`` neighbours the least."""
    lines = [" ".join(x.split()) for x in _HEAD_COMMENT.sub("", source, count=1).split("\n")]
    lines = [x for x in lines if x]
    runs = [xxhash.xxh64_intdigest("\n".join(lines[i : i + 3])) >> 1 for i in range(len(lines) - 2)]
    if not runs:
        return []
    return sorted({min(runs[i : i + WINDOW]) for i in range(max(1, len(runs) - WINDOW + 1))})


def file_facts(files: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per file with a source: a number of its own, notice, label, features and prints.

    ``configs`` has one row per repository; it is broadcast if Spark estimates it at ``CONFIG_BYTES`` or less.
    """
    globs = configs.where("repository is not null").groupBy("repository").agg(F.first("exclude").alias("exclude"))
    if plan_bytes(configs) <= CONFIG_BYTES:
        globs = F.broadcast(globs)
    slim = spread(files.select("file_id", "repository", "path", "source"), "file_id").where("source is not null and trim(source) <> ''")
    joined = slim.join(globs, "repository", "left").select("file_id", "path", "source", "exclude")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[tuple, re.Pattern | None] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for path, source, exclude in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                key = tuple(g for g in exclude or () if g)
                if key not in compiled:
                    compiled[key] = re.compile("|".join(f"(?:{glob_regex(g)})" for g in key)) if key else None
                p = normal_path(path)
                notice, _, label = notices(p, source)
                hit = bool(compiled[key] and compiled[key].search(p))
                for column, v in zip(out, (uuid.uuid4().int >> 65, notice, label, features(source, hit), prints(source)), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            arrays = [batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["file_id", "row", "notice", "label", "features", "prints"])

    kind = slim.schema["file_id"].dataType.simpleString()
    return joined.mapInArrow(read, f"file_id {kind}, row bigint, notice string, label int, features array<double>, prints array<bigint>")


def with_copies(facts: DataFrame) -> DataFrame:
    """``facts`` with ``copied``: whether ``COPY`` or more of a file's prints stand in files with a third-party notice."""
    known = facts.where("notice = 'third_party'").select(F.explode("prints").alias("print")).distinct()
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = facts.where("notice is null").select("row", F.explode("prints").alias("print"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    hits = held.join(salted, ["print", "salt"]).groupBy("row").agg(F.count("*").alias("hits"))
    return facts.join(hits, "row", "left").withColumn("copied", F.coalesce(F.col("hits") >= COPY * F.size("prints"), F.lit(False))).drop("hits", "prints", "row")


def train(facts: DataFrame, trees: int = 40, depth: int = 8):  # noqa: ANN201
    """A forest fitted on the labelled files (see ``MAX_TRAINING``), or None without labels of both kinds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    labelled = facts.where("label is not null")
    n = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        return None
    part = min(1.0, MAX_TRAINING / sum(n.values()))
    weight = F.when(F.col("label") == 1, 1.0).otherwise(n[1] / n[0])
    sample = labelled.where(F.pmod(F.xxhash64("file_id"), F.lit(1 << 20)) < part * (1 << 20)).select(
        array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight")
    )
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, weightCol="weight", subsamplingRate=0.8, featureSubsetStrategy="sqrt")
    return forest.fit(sample)


def judged(files: DataFrame, configs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, notice, probability, copied, by_hand) of every file with a source; the forest scores every file."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    facts = materialise(with_copies(materialise(file_facts(files, configs), "file-prints")), "file-facts")
    model = train(facts)
    scored = facts.withColumn("vector", array_to_vector("features"))
    if model is None:
        scored = scored.withColumn("p", F.lit(0.0))
    else:
        model.setFeaturesCol("vector").setProbabilityCol("probability")
        scored = model.transform(scored).withColumn("p", vector_to_array("probability")[1])
    by_hand = (F.col("p") < threshold) & F.col("notice").isNull() & ~F.col("copied")
    return scored.select("file_id", "notice", F.col("p").alias("probability"), "copied", by_hand.alias("by_hand"))


def not_by_hand(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(file_id) of the files not written by hand."""
    return judged(files, configs).where("not by_hand").select("file_id")
