"""Fixed schemas of sequence tables, and their enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = {"": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def schema(text: str) -> StructType:
    """From "name name:type ..."; strings unless said otherwise."""
    fields = (part.partition(":") for part in text.split())
    return StructType([StructField(name, _TYPES[kind]) for name, _, kind in fields])


PARTICIPANT = schema(
    "participant_label participant_age participant_description specimen_label specimen_time_point amplification_locus amplification_template "
    "amplification_label replicate_label run_label trimmed_sequence v_segment j_segment v_score:double productive "
    "fr1_seq_aa_q cdr1_seq_aa_q fr2_seq_aa_q cdr2_seq_aa_q fr3_seq_aa_q cdr3_seq_aa_q post_seq_aa_q v_sequence"
)
PARTICIPANT_BCR = StructType([*PARTICIPANT, *schema("igh_clone_id:long spam_score:double isosubtype")])
PARTICIPANT_TCR = StructType([*PARTICIPANT, *schema("tcrb_clone_id:long")])
REGIONS = ("fr1", "cdr1", "fr2", "cdr2", "fr3", "cdr3", "post")
CANONICAL = StructType(
    [
        *(f for f in PARTICIPANT if f.name != "productive"),
        *schema(
            "productive:boolean spam_score:double isosubtype row_id_in_participant_table:long igh_or_tcrb_clone_id:long disease disease_subtype "
            "extracted_isotype isotype_supergroup cell_type num_reads:long v_gene j_gene"
        ),
        *schema(" ".join(f"{r}_seq_aa_q_trim" for r in REGIONS)),
        *schema("cdr3_aa_sequence_trim_len:long v_mut:double"),
    ]
)
SAMPLED = schema(
    "participant_label specimen_label amplification_label igh_or_tcrb_clone_id:long isotype_supergroup disease disease_subtype v_gene j_gene "
    + " ".join(f"{r}_seq_aa_q_trim" for r in REGIONS)
    + " cdr3_aa_sequence_trim_len:long v_mut:double num_reads:long total_clone_num_reads:long num_clone_members:long"
)


def enforce(df: DataFrame, wanted: StructType, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """Exactly the wanted columns in their order: missing ones null, others cast, surplus dropped.

    A value outside a column's closed domain becomes null.
    """
    def column(f):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        value = F.col(f"`{f.name}`").cast(f.dataType)
        if domains and f.name in domains:
            value = F.when(value.isin(*domains[f.name]), value)
        return value.alias(f.name)

    return df.select(*map(column, wanted))
