"""What is done with duplicates: a plan as a DataFrame, carried out only when asked."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.operators.views import link_pairs, selected

KINDS = ("trash", "hardlink", "reflink", "copy")
#: Linux's request that makes a file share the blocks of another.
FICLONE = 0x40049409


def plan(members: DataFrame, checked: DataFrame, kind: str) -> DataFrame:
    """action, path and original (null for trash) of each file that would be touched, once each."""
    if kind not in KINDS:
        raise ValueError(f"unknown action {kind!r}")
    if kind == "trash":
        return selected(members.select("path"), checked).distinct().select(F.lit(kind).alias("action"), "path", F.lit(None).cast("string").alias("original"))
    return link_pairs(members, checked).select(F.lit(kind).alias("action"), F.col("duplicate").alias("path"), "original")


def plan_group(members: DataFrame, group_id) -> DataFrame:
    """The plan that puts a whole group into the trash."""
    return members.where(F.col("group_id") == group_id).select("path").distinct().select(F.lit("trash").alias("action"), "path", F.lit(None).cast("string").alias("original"))


def clone(original: str, path: str) -> None:
    """A copy that shares its blocks where the file system can do that, a plain one elsewhere."""
    try:
        import fcntl

        with open(original, "rb") as source, open(path, "xb") as target:
            fcntl.ioctl(target.fileno(), FICLONE, source.fileno())
        shutil.copystat(original, path)
    except (ImportError, OSError):
        shutil.copy2(original, path)


#: How a replacement is made of the original.
REPLACE = {"hardlink": os.link, "reflink": clone, "copy": shutil.copy2}


def carry_out(actions: DataFrame, trash: str | None = None, dry_run: bool = True) -> list[tuple[str, str, str]]:
    """Do a plan on local files, row by row; a dry run, the default, only says what it would do.

    A replacement is made beside the file and renamed over it, so the file is
    there at every moment.
    """
    done = []
    for row in actions.toLocalIterator():
        kind, path, original = row["action"], row["path"], row["original"]
        state = "planned"
        if not dry_run:
            try:
                if kind == "trash":
                    if trash is None:
                        raise ValueError("a trash folder is needed")
                    os.makedirs(trash, exist_ok=True)
                    shutil.move(path, os.path.join(trash, f"{uuid.uuid4().hex}-{os.path.basename(path)}"))
                elif not os.path.samefile(path, original):
                    beside = f"{path}.{uuid.uuid4().hex}"
                    REPLACE[kind](original, beside)
                    os.replace(beside, path)
                state = "done"
            except OSError as e:
                state = f"failed: {e.strerror}"
        done.append((kind, path, state))
    return done
