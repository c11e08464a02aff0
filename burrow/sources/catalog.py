"""Where a project's recordings lie: the ladder of data folders, over a listing of paths.

A project's folder has ``data`` folders beside and above it. Nearest first, a folder in one of them that is named for the project counts, then date folders
right in it; if no ``data`` folder has either, all date folders of the nearest one that has any, whatever project they are named for.

Defined results: a project without recordings has no rows; one file reached two ways is one row; date folders are named ddmmyy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = r"^\d{6}$"
#: What a ladder's step found.
NAMED, DIRECT, ANY = 0, 1, 2


def recordings(projects: DataFrame, files: DataFrame) -> DataFrame:
    """project, path, kind (mcu or video), day (the date folder), tier.

    projects has project (its folder) and names (an array, first choice first); files has path. Logs are ``*.tsv`` in a date folder or its ``mcu``; frame files
    ``*_video_data*.txt`` in its ``video`` or in it.
    """
    p = F.split("path", "/")
    n = F.size(p)
    name, up, up2 = F.get(p, n - 1), F.get(p, n - 2), F.get(p, n - 3)
    in_date = up.rlike(DATE)
    below = up2.rlike(DATE)
    kind = F.when(name.endswith(".tsv") & (in_date | (below & (up == "mcu"))), "mcu").when(name.rlike(r"_video_data(_.*)?\.txt$") & (in_date | (below & (up == "video"))), "video")
    f = files.select("path", kind.alias("kind"), F.when(in_date, n - 2).otherwise(n - 3).alias("at"), p.alias("p")).where("kind IS NOT NULL")
    # the folders from the root to that of the date folder
    f = f.select("path", "kind", F.get("p", F.col("at")).alias("day"), F.get("p", F.col("at") - 1).alias("over"), F.array_join(F.slice("p", F.lit(1), F.col("at")), "/").alias("folder"))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("project", "/")) - 1), lambda i: F.struct(i.alias("level"), F.concat(F.array_join(F.slice(F.split("project", "/"), F.lit(1), F.size(F.split("project", "/")) - i), "/"), F.lit("/data")).alias("data")))
    data = projects.select("project", "names", F.explode(above).alias("d")).select("project", "names", "d.*")
    named = data.select("project", "level", F.posexplode("names").alias("choice", "name"), "data").select("project", "level", F.lit(NAMED).alias("tier"), "choice", F.concat_ws("/", "data", "name").alias("folder"))
    direct = data.select("project", "level", F.lit(DIRECT).alias("tier"), F.lit(0).alias("choice"), F.col("data").alias("folder"))
    first = named.unionByName(direct).join(f, "folder")
    other = data.select("project", "level", F.lit(ANY).alias("tier"), F.lit(0).alias("choice"), F.col("data").alias("parent")).join(f.withColumn("parent", F.regexp_replace("folder", "/[^/]*$", "")), "parent")
    # a nearer data folder goes before, in it a named folder before dates; any project's dates come after all of these
    place = F.struct((F.col("tier") == ANY).cast("int").alias("last"), F.col("level"), F.col("tier"), F.col("choice"))
    columns = ["project", "path", "kind", "day", "tier", "level", "choice"]
    every = first.select(*columns).unionByName(other.select(*columns)).withColumn("place", place)
    best = every.groupBy("project").agg(F.min("place").alias("best"))
    return every.join(best, "project").where(F.col("place") == F.col("best")).select("project", "path", "kind", "day", "tier").distinct()
