"""Names, schemas and weights that every part of the library agrees on."""

from __future__ import annotations

from pyspark.sql import types as T

# The 20 fields of a formal record, in order; all are text but the last.
FORMAL_FIELDS = (
    "客户", "币种", "业务员", "表头备注", "行号", "物料编码", "物料名称", "规格", "颜色", "面料",
    "面料-涤棉成分", "款式", "加标方式", "尺寸类型", "数量", "行备注", "计划发货日期", "包装方式", "是否绣花", "相似分数",
)
FORMAL_SCHEMA = T.StructType([T.StructField(f, T.StringType(), False) for f in FORMAL_FIELDS[:-1]] + [T.StructField(FORMAL_FIELDS[-1], T.DoubleType(), False)])

# Statuses of a parsed field.
PARSE_STATUSES = ("extracted", "normalized", "derived", "defaulted", "source_not_provided", "unrecognized", "ambiguous", "not_implemented")
WARNING_STATUSES = ("unrecognized", "ambiguous")

# Statuses of a field comparison with their scores (null: left out of the weighted mean), the weights of the
# structured fields, the fields whose conflict removes a candidate, and the blend of structured and vector score.
STATUS_SCORES = {
    "exact_match": 1.0, "equivalent_match": 0.95, "partial_match": 0.60, "missing_query": None,
    "missing_candidate": None, "not_comparable": None, "no_match": 0.0, "hard_conflict": 0.0,
}
COMPARISON_STATUSES = tuple(STATUS_SCORES)
FIELD_WEIGHTS = {"spec": 0.25, "composition": 0.18, "fabric": 0.17, "density": 0.15, "color": 0.10, "style": 0.08, "label_method": 0.04, "size_type": 0.03}
HARD_FIELDS = ("product_category", "spec", "color", "fabric", "composition", "density")
STRUCTURED_SHARE, VECTOR_SHARE = 0.75, 0.25
LEAST_COMPARABLE_FIELDS = 3
TIE = 1e-6

# The columns of the material master and the field each one becomes.
MASTER_COLUMNS = {
    "物料编码": "material_code", "物料名称": "product_category", "规格": "spec", "颜色": "color", "面料": "fabric", "款式": "style",
    "加标方式": "label_method", "尺寸类型": "size_type", "面料-品类": "fabric_category", "面料-纱支": "yarn_count", "面料-密度": "density",
    "面料-涤棉成分": "composition",
}

CELL_SCHEMA = "file string, sha256 string, sheet_idx int, sheet string, visibility string, row int, col int, text string, formula string, number_format string, hidden boolean, anchor_row int, anchor_col int"
