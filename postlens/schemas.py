"""Table contracts, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract type names and the Spark types they map to.
CONTRACT_TYPES = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "dict": T.StringType(),
    "datetime": T.TimestampType(),
    "list[float]": T.ArrayType(T.FloatType()),
}


def struct_from_contract(contract: dict[str, str]) -> T.StructType:
    """Record contract (field -> type name) to a schema; unknown types become strings, all columns nullable."""
    return T.StructType(
        [T.StructField(name, CONTRACT_TYPES.get(kind, T.StringType()), True) for name, kind in contract.items()]
    )


RAW_CONTRACT = {"job_id": "str", "source": "str", "scrape_timestamp": "datetime", "payload": "dict"}

CLEANED_CONTRACT = {
    "source": "str",
    "scrape_timestamp": "datetime",
    "bq_timestamp": "datetime",
    "job_id": "str",
    "job_url": "str",
    "job_title": "str",
    "job_description": "str",
    "job_location": "str",
    "job_classification": "str",
    "job_work_type": "str",
    "job_salary_min_sgd_raw": "float",
    "job_salary_max_sgd_raw": "float",
    "job_salary_type": "str",
    "job_salary_min_sgd_monthly": "float",
    "job_salary_max_sgd_monthly": "float",
    "job_currency": "str",
    "job_posted_timestamp": "datetime",
    "company_id": "str",
    "company_url": "str",
    "company_name": "str",
    "company_description": "str",
    "company_industry": "str",
    "company_size": "str",
}

EMBEDDING_CONTRACT = {
    "job_id": "str",
    "source": "str",
    "model_name": "str",
    "embedding": "list[float]",
    "created_at": "datetime",
}

RAW_SCHEMA = struct_from_contract(RAW_CONTRACT)
CLEANED_SCHEMA = struct_from_contract(CLEANED_CONTRACT)
EMBEDDING_SCHEMA = struct_from_contract(EMBEDDING_CONTRACT)
