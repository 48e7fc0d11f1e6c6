"""Column names and types of the tables that pass between stages, in output order."""

from __future__ import annotations

SIGNALS = "read_name string, chrom string, event_pos bigint, event_end bigint, svtype string, svlen bigint, mapq bigint, strand string, read_len bigint, read_event_start bigint, read_event_end bigint, is_supplementary int, has_sa int, softclip_left bigint, softclip_right bigint, cigar string"
EXTRA = "read_name string, evidence_type string, src_chrom string, src_start bigint, src_end bigint, src_strand string, dst_chrom string, dst_start bigint, dst_end bigint, dst_strand string, event_pos bigint, event_len bigint, mapq bigint, dst_mapq bigint, chrom_change int, orientation_change int, is_supplementary int, has_sa int, softclip_left bigint, softclip_right bigint, cigar string, sa_cigar string, nm bigint, source string"
CANDIDATES = "candidate_id string, chrom string, start bigint, end bigint, svtype string, median_svlen bigint, support_read_count bigint, mean_mapq double, std_pos double, std_svlen double, read_names array<string>, signal_indices array<bigint>"
EXTRA_CANDIDATES = "chrom string, start bigint, end bigint, svtype string, svlen bigint, median_svlen bigint, support bigint, source string, mean_pos double, mean_size double"
MERGED_MORE = "candidate_source string, extra_support bigint, matched_extra_count bigint, extra_source string"
LABEL_MORE = "label int, matched_truth_id string, matched_truth_pos bigint, matched_truth_svlen bigint, size_similarity double, pos_distance bigint"
TRUTH = "truth_id string, chrom string, pos bigint, svtype string, svlen bigint, truth_ordinal bigint"
PREDICTIONS = "candidate_id string, chrom string, start bigint, end bigint, svtype string, median_svlen bigint, support_read_count bigint, label int, gnn_prob double, gnn_pred int"
ALIGNMENTS = "record_ordinal bigint, qname string, flag int, rname string, pos bigint, mapq bigint, cigar string, seq_len bigint, sa string, nm bigint"

#: Feature names of the two graph versions: fixed values.
FEATURES_V1 = (
    "svtype_DEL", "svtype_INS", "log_svlen", "log_support", "mean_mapq_norm", "std_pos_norm", "std_svlen_norm", "log_read_len",
    "read_mapq_norm", "strand_numeric", "distance_to_candidate_center_norm", "relative_svlen_diff", "has_sa", "is_supplementary",
    "is_candidate_node", "is_read_node",
)
FEATURES_V2 = (
    "svtype_DEL", "svtype_INS", "log_length", "log_support_or_read_len", "mapq_norm", "strand_numeric", "distance_norm", "has_sa",
    "is_supplementary", "chrom_change", "orientation_change", "is_candidate", "is_cigar_del", "is_cigar_ins", "is_softclip_left",
    "is_softclip_right", "is_sa_connection", "is_supplementary_evidence",
)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def types(schema: str) -> dict[str, str]:
    return dict(c.split(None, 1) for c in schema.split(", "))
