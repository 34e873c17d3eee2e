"""Schemas of what a monitoring run reads and writes."""

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _of(text: str) -> StructType:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "b": BooleanType(), "t": TimestampType(), "a": ArrayType(StringType())}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


#: A document to watch, and the set that it belongs to.
WATCHED = _of("url:s selector:s label:s render:b force_proxy:b")
POLICY_SET = StructType([StructField("setName", StringType()), StructField("category", StringType()), StructField("urls", ArrayType(WATCHED)), StructField("render", BooleanType()), StructField("force_proxy", BooleanType())])
#: What a fetch brought.
CAPTURE = _of("run_id:s captured_at:t set_name:s url:s status:s text:s etag:s last_modified:s http_status:i extractor:s error:s attempts:i duration_ms:l")
#: What is known of a document between runs; its text is in BASELINE.
DOCUMENT = _of("set_name:s url:s doc_id:s label:s hash:s length:l etag:s last_modified:s extractor:s pipeline_version:i consecutive_failures:l last_checked:s last_success:s last_error:s last_changed:s status:s http_status:i fetch_ms:l diff_added:l diff_removed:l suspect_length:l rebaseline_reason:s")
BASELINE = _of("set_name:s url:s text:s")
STORED_TEXT = _of("set_name:s url:s text:s length:l")
CHANGE = _of("timestamp:s verdict:s changed_documents:a added:l removed:l tags:a")
REVIEW = _of("timestamp:s verdict:s summary:s changed_documents:a")
SET = StructType([*_of("set_name:s hash:s category:s file_id:s last_checked:s last_amended:s last_priority:s last_verdict:s").fields, StructField("last_change", CHANGE), StructField("last_review", REVIEW), *_of("schema_failures:l consecutive_failures:l last_success:s status:s").fields])
ANALYSIS = StructType([*_of("verdict:s summary:s analysis:s priority:s date_time:s changed_documents:a").fields, StructField("diff_stats", _of("added:l removed:l")), StructField("fingerprint", ArrayType(StringType()))])
#: Records of documents and of sets in one: what one kind lacks is null.
RUN_LOG = _of("run_id:s timestamp:s set_name:s file_id:s url:s label:s outcome:s http_status:i length:l diff_added:l diff_removed:l tags:a error:s fetch_ms:l llm_called:b llm_attempts:i prompt_tokens:l output_tokens:l verdict:s priority:s")
#: What a run knows of a set from the run before.
SET_STATE = _of("set_name:s category:s file_id:s hash:s last_checked:s last_amended:s last_priority:s last_verdict:s review_verdict:s review_summary:s schema_failures:l consecutive_failures:l last_success:s")
#: Texts of a set - its analysis, snapshot and diff - in numbered parts, copies of them under the names of the archive, and what the archived analyses say.
ARTEFACT = _of("set_name:s file_id:s kind:s part:l at:s text:s")
ARCHIVED = _of("file_name:s part:l text:s")
HISTORY = _of("file_id:s stamp:s ts:t analysis_path:s snapshot_path:s diff_path:s priority:s verdict:s summary:s changed_documents:a")
