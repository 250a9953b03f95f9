"""The few expressions that two SQL dialects write differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def like(x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    @staticmethod
    def gsub(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    @staticmethod
    def sub(x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    @staticmethod
    def joined(x: str, order: str, sep: str = ",") -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    @staticmethod
    def sha256(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def seconds(x: str) -> str:
        return f"unix_timestamp({x})"

    lines = "SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (paragraph_index, line) FROM documents"


class Duck(Spark):
    name = "duckdb"

    @staticmethod
    def like(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    @staticmethod
    def gsub(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    @staticmethod
    def sub(x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    @staticmethod
    def joined(x: str, order: str, sep: str = ",") -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    @staticmethod
    def sha256(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def seconds(x: str) -> str:
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    lines = "SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS paragraph_index, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)"
