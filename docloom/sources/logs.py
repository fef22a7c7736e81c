"""Append-only JSONL logs, the learned store, profile sidecars and model artifacts.

Logs have explicit schemas. Older lines lack newer keys: missing keys take their
defaults, unknown ones are ignored, and lines that are malformed or lack a
required key are skipped. A missing log is an empty one.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION = "struct<predicted_verdict:string,predicted_verdict_score:double,predicted_reason:string,predicted_reason_score:double,model_trained_at:string>"
DECISION = (
    "schema int, timestamp bigint, source string, value string, method string, detected_type string, verdict string, final_type string, "
    "shown_context string, block_context string, occurrences int, doc_id string, scope string, block_kinds array<string>, heading_level tinyint, "
    "langs array<string>, span_edited boolean, context_edited boolean, user_added boolean, "
    f"neighbors struct<above:string,below:string,col_header:string,row_label:string>, prediction {PREDICTION}"
)
STYLING = (
    "schema int, source string, doc_id string, lang string, lang_confidence float, block_index bigint, block_kind string, heading_level tinyint, "
    "in_table boolean, text string, para struct<style_name:string,alignment:string,indent:struct<left:int,right:int,hanging:int,first_line:int>,"
    "numbering:struct<num_id:bigint,ilvl:bigint>,spacing:struct<before:int,after:int,line:int>>, "
    "run struct<font:string,size_half_pt:bigint,bold:boolean,italic:boolean,underline:string,color:string>, "
    "segments array<struct<text:string,style:struct<font:string,size_half_pt:bigint,bold:boolean,italic:boolean,underline:string,color:string,strike:boolean,caps:boolean,char_spacing:int>>>, "
    "numbering_format struct<kind:string,level_text:string>, style_unresolved boolean, numbering_unresolved boolean, "
    "relative struct<style_doc_freq:float,font_matches_doc_dominant:boolean,size_matches_doc_dominant:boolean,matches_role_peers:boolean,indent_vs_ilvl_norm:float>, "
    f"context struct<prev_text:string,next_text:string,prev_kind:string,next_kind:string,prev_numbering:struct<num_id:bigint,ilvl:bigint>,next_numbering:struct<num_id:bigint,ilvl:bigint>>, "
    f"verdict string, category string, note string, prediction {PREDICTION}"
)
REQUIRED = ("schema", "timestamp", "source", "value", "shown_context", "block_context")
STORE = "value string, type string, allow bigint, deny bigint"
ARTIFACT_VERSION = 1


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _defaults(df: DataFrame, schema: T.StructType, required: tuple[str, ...]) -> DataFrame:
    """Strings become "", numbers 0, flags false and lists empty where a key is missing; optional values stay null."""
    optional = {"heading_level", "final_type", "prediction", "category", "note", "neighbors", "numbering_format", "prediction", "lang_confidence"}
    out = []
    for f in schema:
        c = F.col(f.name)
        if f.name not in optional and f.name not in required:
            if isinstance(f.dataType, T.StringType):
                c = F.coalesce(c, F.lit(""))
            elif isinstance(f.dataType, T.BooleanType):
                c = F.coalesce(c, F.lit(False))
            elif isinstance(f.dataType, T.NumericType):
                c = F.coalesce(c, F.lit(0).cast(f.dataType))
            elif isinstance(f.dataType, T.ArrayType):
                c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out, *[c for c in df.columns if c not in schema.names])


def read_log(spark: SparkSession, path: str, schema: str = DECISION, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows of a JSONL log; ``seq`` if it was written with one."""
    kind = T.StructType.fromDDL(schema)
    full = T.StructType([*kind.fields, T.StructField("seq", T.LongType()), T.StructField("_corrupt", T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([*kind.fields, T.StructField("seq", T.LongType())]))
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = rows.where("_corrupt is null")
    for name in required:
        good = good.where(F.col(name).isNotNull())
    return _defaults(good.drop("_corrupt"), kind, required)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object per line, behind what is there. Order is kept in the rows' own ``seq``."""
    rows.write.mode("append").json(path)


def save_store(store: DataFrame, path: str) -> None:
    """The learned tallies as JSON lines."""
    store.select("value", "type", "allow", "deny").write.mode("overwrite").json(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).json(path) if _exists(spark, path) else spark.createDataFrame([], STORE)


def write_sidecars(profiles: DataFrame, path: str) -> None:
    """One folder per document with its profile as JSON."""
    profiles.write.mode("overwrite").partitionBy("doc_id").json(path)


def save_artifact(model: dict, path: str, version: int = ARTIFACT_VERSION) -> None:
    """A model file that is whole or absent: written beside its place, then moved."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, made = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        json.dump({"version": version, "model": model}, f, indent=2)
    os.replace(made, path)


def load_artifact(path: str, version: int = ARTIFACT_VERSION) -> dict | None:
    """The model, or None where the file is missing, corrupt or of another version."""
    try:
        with open(path) as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found.get("model") if isinstance(found, dict) and found.get("version") == version else None


def ensure_writable(spark: SparkSession, paths: list[str], force: bool = False) -> None:
    """Raise if any target exists, before any is written."""
    taken = [p for p in paths if not force and _exists(spark, p)]
    if taken:
        raise FileExistsError(f"already there: {', '.join(taken)}")


def data_root(flag: str | None = None, variable: str = "DOCLOOM_DATA") -> str:
    """Where stores live: the flag, the environment, XDG, then the home folder."""
    if flag or os.environ.get(variable):
        return flag or os.environ[variable]
    return os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "docloom")


def model_root(model_flag: str | None = None, root_flag: str | None = None, variable: str = "DOCLOOM_MODELS") -> str:
    """The models' folder: its own flag or variable come before those of the data root."""
    return model_flag or os.environ.get(variable) or os.path.join(data_root(root_flag), "models")
