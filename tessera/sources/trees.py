"""File trees as Spark data sources: read in folders, each pruned by the ignore files above it; written with a commit.

``tree`` reads files below a root that driver and executors share. Planning lists only the
first levels of folders, until there are enough of them for the tasks; a task walks its folder,
carries the ignore rules down, and never enters what they or the skip list exclude.

``guarded`` writes rows (path, text) as files below one folder of a root. Tasks write drafts, packed
into a few files; the commit makes them files and marks the job, or throws all away. ``write_files``
deals that out to tasks as well, so that the driver passes on names of packs only.
"""

from __future__ import annotations

import ctypes
import fcntl
import functools
import itertools
import os
import re
import shutil
import signal
import stat
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Folders that hold no sources.
SKIP_FOLDERS = ("node_modules", ".git", "vendor", "dist", "build", "out", "coverage", ".next", ".turbo", ".cache", "__pycache__")
#: Folders with a leading dot that are entered all the same.
HIDDEN_KEPT = (".memory", ".cursor", ".windsurf", ".github")
IGNORE_FILE = ".gitignore"
ROW = "path string, size long, mtime timestamp, text string, has_nul boolean, reason string"
#: Folders to plan at least, where there are so many; names of one folder for a task, and shares of one folder at most, as each lists it all; bytes of one batch; drafts of one pack.
SPLITS, NAMES, SHARES, BATCH_BYTES, PACK = 64, 20_000, 16, 8 << 20, 4096
HUMAN = re.compile(r"<!-- human:start -->.*?<!-- human:end -->", re.S)


@dataclass
class Folder(InputPartition):
    """A folder to read (below the root), alone or with all below; ``part`` of ``parts`` takes its share of the names."""

    path: str
    deep: bool
    rules: tuple[tuple[str, str, bool], ...]  # (folder of the ignore file, expression, negated), from the root down
    part: int = 0
    parts: int = 1


def local_path(root: str) -> str:
    """A folder that driver and executors share, as a path; other schemes than file aren't trees here."""
    scheme, colon, rest = root.partition(":")
    if colon and "/" not in scheme and len(scheme) > 1:
        if scheme != "file":
            raise ValueError(f"{root} isn't a folder that tasks can walk")
        root = re.sub("^//+", "/", rest)
    return os.path.abspath(root)


class Walk:
    """A tree's folders and files under its ignore rules."""

    def __init__(self, root: str, skip: tuple[str, ...], keep: tuple[str, ...], ignore: str):
        self.root, self.skip, self.keep, self.ignore = local_path(root), skip, keep, ignore
        self.real = os.path.realpath(self.root)

    def at(self, path: str) -> str:
        return os.path.join(self.root, path)

    def inside(self, full: str) -> bool:
        real = os.path.realpath(full)
        return real == self.real or real.startswith(self.real + os.sep)

    def with_own(self, path: str, rules: tuple) -> tuple:
        """Rules with those of the folder's ignore file."""
        from ..operators.policy import ignore_regex

        full = self.at(os.path.join(path, self.ignore))
        if not self.ignore or not os.path.isfile(full) or not self.inside(full):
            return rules
        with open(full, encoding="utf-8", errors="replace") as f:
            lines = [line.strip() for line in f]
        return (*rules, *[(path, ignore_regex(line.lstrip("!")), line.startswith("!")) for line in lines if line and not line.startswith("#")])

    def ignored(self, path: str, rules: tuple) -> bool:
        """Within a folder's rules the last that fits decides; the first folder from the root down that ignores settles it."""
        verdict: dict[str, bool] = {}
        for folder, expression, negated in rules:
            if re.match(expression, path[len(folder) + 1 :] if folder else path):
                verdict[folder] = not negated
        return any(verdict.values())

    def entries(self, path: str, rules: tuple, part: int = 0, parts: int = 1) -> Iterator[tuple[str, os.DirEntry | None, str | None]]:
        """(path, entry, reason why it is passed over) of a share of a folder's entries by name; a folder that is gone has none."""
        try:
            mine = (e for e in os.scandir(self.at(path)) if parts == 1 or zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % parts == part)
            listed = sorted(mine, key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return
        yield from self.judged(path, listed, rules)

    def listed(self, path: str) -> tuple[int, list[os.DirEntry]]:
        """How many entries a folder has, and the folders among them by name."""
        try:
            names, found = 0, []
            for e in os.scandir(self.at(path)):
                names += 1
                if e.is_dir(follow_symlinks=False):
                    found.append(e)
            return names, sorted(found, key=lambda e: e.name)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return 0, []

    def judged(self, path: str, listed: list[os.DirEntry], rules: tuple) -> Iterator[tuple[str, os.DirEntry, str | None]]:
        for e in listed:
            below = f"{path}/{e.name}" if path else e.name
            if e.name == ".DS_Store":
                continue
            if e.is_symlink() and not self.inside(e.path):
                yield below, e, "symlink-escape"
            elif e.is_dir(follow_symlinks=False):
                hidden = e.name.startswith(".") and e.name not in self.keep
                yield below, e, "excluded-folder" if hidden or e.name in self.skip else "ignored" if self.ignored(below, rules) else None
            elif e.is_file():
                yield below, e, "ignored" if self.ignored(below, rules) else None

    def folders(self, splits: int) -> list[Folder]:
        """Folders for tasks: expanded level by level until there are ``splits``, wide ones in shares of NAMES."""
        waiting, done = [("", ())], []
        while waiting and len(waiting) + len(done) < splits:
            below = []
            for path, rules in waiting:
                rules = self.with_own(path, rules)
                names, found = self.listed(path)
                below += [(at, rules) for at, _, reason in self.judged(path, found, rules) if reason is None]
                parts = min(-(-names // NAMES), SHARES) or 1
                done += [Folder(path, False, rules, i, parts) for i in range(parts)]
            waiting = below
        return done + [Folder(path, True, rules) for path, rules in waiting]

    def files(self, f: Folder) -> Iterator[tuple[str, os.DirEntry, str | None]]:
        """Files of a planned folder, and what is passed over, with the reason."""
        waiting = [(f.path, self.with_own(f.path, f.rules) if f.deep else f.rules)]
        while waiting:
            path, rules = waiting.pop()
            for at, e, reason in self.entries(path, rules, f.part, f.parts):
                if reason is None and e.is_dir(follow_symlinks=False):
                    if f.deep:
                        waiting.append((at, self.with_own(at, rules)))
                elif reason or e.is_file():
                    yield at, e, reason


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        named = lambda key, default: tuple(x for x in options.get(key, "\n".join(default)).split("\n") if x)
        self.walk = Walk(options["root"], named("skip", SKIP_FOLDERS), named("keep", HIDDEN_KEPT), options.get("ignore", IGNORE_FILE))
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None
        self.splits = int(options.get("splits", SPLITS))

    def partitions(self) -> list[InputPartition]:
        return list(self.walk.folders(self.splits))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, e, reason in self.walk.files(partition):
            try:
                found = e.stat(follow_symlinks=reason is None)
                data = None
                if reason is None and (self.most is None or found.st_size <= self.most):
                    with open(e.path, "rb", 0) as f:
                        data = f.read()
            except FileNotFoundError:  # gone since it was listed
                continue
            nul = data is not None and b"\0" in data
            text = None if data is None or nul else data.decode("utf-8", "replace")
            rows.append((path, found.st_size, int(found.st_mtime * 1_000_000), text, nul, reason))
            size += len(data or b"") + 200
            if size > BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "size", "mtime", "text", "has_nul", "reason"])


class Tree(DataSource):
    """Options: root; max_bytes (texts of longer files are null); splits; skip and keep (names, one a line); ignore (an ignore file's name, or empty)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """ROW rows of the files below root, and of the folders, links and files that are passed over, with the reason."""
    spark.dataSource.register(Tree)
    return spark.read.format("tree").options(root=root, **{k: str(v) for k, v in options.items() if v is not None}).load()


# ------------------------------------------------------------------ writing


class OutsideFolder(ValueError):
    """A path that a guarded sink may not write to."""


def guarded_path(path: str | None, within: str) -> str:
    """A relative path below ``within``, as it is; anything else raises."""
    parts = (path or "").replace("\\", "/").split("/")
    own = within.strip("/").split("/")
    if parts[: len(own)] != own or len(parts) <= len(own) or any(p in ("", ".", "..") for p in parts):
        raise OutsideFolder(f"{path!r} isn't below {within}")
    return "/".join(parts)


def with_human_blocks(existing: str, text: str) -> str:
    """Text, followed by the blocks between human marks of what it replaces."""
    blocks = [b for b in HUMAN.findall(existing) if b not in text]
    return text.rstrip() + "\n\n" + "\n".join(blocks) + "\n" if blocks else text


@dataclass
class Drafts(WriterCommitMessage):
    folder: str


def marker_of(root: str, within: str, job: str) -> str:
    return os.path.join(root, within, ".jobs", f"{zlib.crc32(job.encode()):08x}-{re.sub(r'[^A-Za-z0-9_-]', '_', job)[:100]}")


def mark(marker: str, job: str) -> None:
    os.makedirs(os.path.dirname(marker), exist_ok=True)
    with open(marker, "x", encoding="utf-8") as f:
        f.write(job)


def packs_of(folder: str) -> list[str]:
    """The packs of a task's folder."""
    with open(os.path.join(folder, "names"), encoding="utf-8") as names:
        return [os.path.join(folder, name) for name in names.read().splitlines()]


def packed(pack: str) -> Iterator[pa.RecordBatch]:
    """Batches (path, text) of a pack; what isn't looked at isn't read."""
    with pa.memory_map(pack) as source, pa.ipc.open_file(source) as f:
        for i in range(f.num_record_batches):
            yield f.get_batch(i)


def paths_of(pack: str) -> Iterator[str]:
    for batch in packed(pack):
        yield from batch.column(0).to_pylist()


@functools.cache
def renameat2():
    """The C library's call that can exchange two names, or None."""
    try:
        call = ctypes.CDLL(None, use_errno=True).renameat2
    except (AttributeError, OSError):
        return None
    call.argtypes = (ctypes.c_int, ctypes.c_char_p, ctypes.c_int, ctypes.c_char_p, ctypes.c_uint)
    return call


def standing(full: str) -> bytes | None:
    try:
        with open(full, "rb", 0) as f:
            return f.read()
    except FileNotFoundError:
        return None


def take_new(draft: str, full: str) -> bool:
    """The draft gets a name that nothing has; False if something has it. A link, as renames from folder to folder hold up each other."""
    try:
        os.link(draft, full)
    except FileExistsError:
        return False
    except OSError:  # no links here
        if os.path.lexists(full):
            return False
        os.replace(draft, full)
        return True
    os.unlink(draft)
    return True


def take_over(draft: str, full: str) -> bool:
    """The draft takes a file's name in one step; True if that file now has the draft's.

    Names are exchanged where that can be done: at a rename over a file, some file systems write out the one that is renamed, and wait.
    """
    at_cwd, exchange = -100, 2  # fixed values of Linux
    if (call := renameat2()) is not None and call(at_cwd, os.fsencode(draft), at_cwd, os.fsencode(full), exchange) == 0:
        return True
    os.replace(draft, full)
    return False


def kind(s: os.stat_result) -> tuple:
    return s.st_mode, s.st_uid, s.st_gid


def written_anew(draft: str, text: bytes, like: tuple) -> bool:
    """Write a text into a file that was replaced; False, with the file to be left, unless it is as a new one would be and nobody else can see it.

    It has no other name, and a write lease is given only where nobody else has it open.
    """
    try:
        fd = os.open(draft, os.O_WRONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError:
        return False
    try:
        s = os.fstat(fd)
        if not text or not stat.S_ISREG(s.st_mode) or s.st_nlink != 1 or kind(s) != like or os.listxattr(fd):
            return False
        fcntl.fcntl(fd, fcntl.F_SETSIG, signal.SIGURG)  # which is ignored, if one should come while the lease is held
        fcntl.fcntl(fd, fcntl.F_SETLEASE, fcntl.F_WRLCK)
        done = 0
        while done < len(text):
            done += os.pwrite(fd, memoryview(text)[done:], done)
        if s.st_size != len(text):
            os.ftruncate(fd, len(text))
        return True
    except (OSError, AttributeError):  # no leases here, or none to be had
        return False
    finally:
        os.close(fd)


def name_pack(root: str, pack: str) -> str:
    """Each draft of a pack becomes a file, with the human blocks of what it replaces; a run after one that was cut off makes all again.

    A file that was replaced holds the next draft, as making and deleting files costs more than writing. Those that can't are left to be
    deleted in the folder whose name is given, for file systems may keep the places of what was just deleted, and search them for each new file.
    """
    own = f"{pack}-{uuid.uuid4().hex}"
    os.mkdir(own)  # beside the pack: when the job is over there is no such place, and a task that outlives it makes nothing
    made, exists, names, spare, like = set(), {}, itertools.count(), None, None

    def drafted(text: bytes) -> str:
        nonlocal spare, like
        draft, spare = spare, None
        if draft and written_anew(draft, text, like):
            return draft
        with open(draft := os.path.join(own, str(next(names))), "xb", 0) as f:
            view = memoryview(text)
            while view:
                view = view[f.write(view) :]
            like = like or kind(os.fstat(f.fileno()))
        return draft

    for batch in packed(pack):
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            full, new = os.path.join(root, path), (text.as_py() or "").encode()
            if (above := os.path.dirname(full)) not in made:
                os.makedirs(above, exist_ok=True)
                made.add(above)
            old = standing(full) if exists.get(above, True) else None  # a wrong guess shows when the name is taken
            exists[above] = old is not None
            if old is None:
                if take_new(draft := drafted(new), full):
                    continue
                old, spare, exists[above] = standing(full), draft, True
            if old and b"<!-- human:start -->" in old:
                new = with_human_blocks(old.decode(), new.decode()).encode()
            draft = drafted(new)
            if take_over(draft, full):
                spare = draft
    return own


def name_drafts(root: str, folder: str) -> int:
    packs = packs_of(folder)
    for pack in packs:
        name_pack(root, pack)
    return sum(batch.num_rows for pack in packs for batch in packed(pack))


class GuardedWriter(DataSourceWriter):
    """Packs of drafts below a hidden folder of this attempt's own, one folder a task, each with a list of its packs."""

    def __init__(self, options: dict[str, str]):
        self.root, self.within = local_path(options["root"]), options["within"].strip("/")
        self.job = options.get("job") or uuid.uuid4().hex
        self.later = "attempt" in options  # write_files names the drafts
        self.attempt = os.path.join(self.root, self.within, ".drafts", options.get("attempt") or uuid.uuid4().hex)
        os.makedirs(self.attempt)  # here, not by tasks: one that outlives the job finds no folder to write to
        self.marker = marker_of(self.root, self.within, self.job)
        self.done = os.path.exists(self.marker)  # a replay's paths are checked, but nothing is drafted

    def check_inside(self, path: str, own: str, known: set[str]) -> None:
        """Raise for a path that links lead out of the folder, which really is ``own``; ``known`` are folders that were found inside."""
        full = os.path.join(self.root, path)
        above = os.path.dirname(full)
        if above not in known:
            if not f"{os.path.realpath(above)}/".startswith(own + os.sep):
                raise OutsideFolder(f"{path!r} leads out of {self.within}")
            known.add(above)
        if os.path.islink(full) and not os.path.realpath(full).startswith(own + os.sep):
            raise OutsideFolder(f"{path!r} leads out of {self.within}")

    def write(self, iterator) -> Drafts:
        rows = iter(iterator)
        parts = iter(lambda: list(itertools.islice(rows, PACK)), [])
        return self.draft(([row["path"] for row in part], pa.array([row["text"] for row in part], pa.large_string())) for part in parts)

    def draft(self, parts: Iterator[tuple[list[str], pa.Array]]) -> Drafts:
        """Paths with their texts, packed as they come."""
        folder, known = os.path.join(self.attempt, uuid.uuid4().hex), set()
        os.mkdir(folder)
        own = os.path.realpath(os.path.join(self.root, self.within))
        pack, n, rows, size = None, 0, 0, 0
        with open(os.path.join(folder, "names"), "w", encoding="utf-8") as names:
            try:
                for paths, texts in parts:
                    paths = [guarded_path(path, self.within) for path in paths]
                    for path in paths:
                        self.check_inside(path, own, known)
                    for at in range(0, 0 if self.done else len(paths), PACK):
                        batch = pa.RecordBatch.from_arrays([pa.array(paths[at : at + PACK], pa.string()), texts.slice(at, PACK)], names=["path", "text"])
                        if pack and (rows + batch.num_rows > PACK or size > BATCH_BYTES):
                            pack.close()
                            pack = None
                        if not pack:
                            pack, n, rows, size = pa.ipc.new_file(os.path.join(folder, str(n)), batch.schema), n + 1, 0, 0
                            names.write(f"{n - 1}\n")
                        pack.write_batch(batch)
                        rows, size = rows + batch.num_rows, size + batch.nbytes
            finally:
                if pack:
                    pack.close()
        return Drafts(folder)

    def commit(self, messages) -> None:
        """Each draft becomes a file, with the human blocks of what it replaces. A job that is marked changes nothing."""
        if self.later and not self.done:
            with open(os.path.join(self.attempt, "folders"), "w", encoding="utf-8") as f:
                f.writelines(f"{m.folder}\n" for m in messages)
            return
        try:
            if self.done or os.path.exists(self.marker):
                return
            seen = set()
            for m in messages:
                for path in itertools.chain.from_iterable(map(paths_of, packs_of(m.folder))):
                    if path in seen:
                        raise ValueError(f"{path} is written twice")
                    seen.add(path)
            for m in messages:
                name_drafts(self.root, m.folder)
            mark(self.marker, self.job)
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        """What this attempt's tasks wrote goes, also that of tasks that were lost."""
        shutil.rmtree(self.attempt, ignore_errors=True)


class BatchWriter(DataSourceArrowWriter, GuardedWriter):
    """A guarded writer of Arrow batches, whose texts go to the packs as they are."""

    def write(self, iterator) -> Drafts:
        return self.draft((batch.column("path").to_pylist(), batch.column("text")) for batch in iterator)


class Guarded(DataSource):
    """Options: root; within (the only folder below it that may be written); job (its name: a job is done once); attempt (of write_files: its drafts' folder, which it names itself)."""

    @classmethod
    def name(cls) -> str:
        return "guarded"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> GuardedWriter:
        return BatchWriter(self.options)


def write_files(rows: DataFrame, root: str, within: str, job: str | None = None) -> None:
    """Rows (path, text) as files below root/within: all of them or none; paths elsewhere are refused, human blocks stay, a job done before changes nothing."""
    spark = rows.sparkSession
    spark.dataSource.register(Guarded)
    options = {"root": root, "within": within, "job": job or uuid.uuid4().hex, "attempt": uuid.uuid4().hex}
    rows.select("path", "text").write.format("guarded").options(**options).mode("append").save()
    base = local_path(root)
    attempt = os.path.join(base, within.strip("/"), ".drafts", options["attempt"])
    if not os.path.exists(listed := os.path.join(attempt, "folders")):  # a replay
        return
    try:
        with open(listed, encoding="utf-8") as f:
            folders = f.read().splitlines()
        packs = list(itertools.chain.from_iterable(map(packs_of, folders)))

        def on_tasks(step, rows: list[str], schema: str, each: int = 1) -> DataFrame:
            """Rows of step's frames, one for each of ``rows``, which are dealt out so many to a task."""

            def steps(batches):
                for batch in batches:
                    for n in batch["id"]:
                        yield step(rows[n])

            return spark.range(0, len(rows), 1, max(-(-len(rows) // each), 1)).mapInPandas(steps, schema)

        if twice := on_tasks(lambda pack: pd.DataFrame({"path": list(paths_of(pack))}), packs, "path string", 8).groupBy("path").count().where("count > 1").first():
            raise ValueError(f"{twice.path} is written twice")
        named = on_tasks(lambda pack: pd.DataFrame({"folder": [name_pack(base, pack)]}), packs, "folder string").collect()
        mark(marker_of(base, within.strip("/"), options["job"]), options["job"])
        if replaced := [r.folder for r in named if any(os.scandir(r.folder))]:
            on_tasks(lambda folder: pd.DataFrame({"gone": [shutil.rmtree(folder, ignore_errors=True) is None]}), replaced, "gone boolean").count()
    finally:
        shutil.rmtree(attempt, ignore_errors=True)


def delete_folder(root: str, within: str) -> bool:
    """Remove what a guarded sink keeps below root/within; False if there is nothing."""
    full = os.path.join(local_path(root), guarded_path(f"{within.strip('/')}/x", within.strip("/")).removesuffix("/x"))
    if os.path.islink(full) or not os.path.isdir(full):
        return False
    shutil.rmtree(full)
    return True
