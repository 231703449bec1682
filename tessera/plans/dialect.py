"""The few differences between Spark SQL and DuckDB SQL that the stand-in tables need."""

from __future__ import annotations


class Spark:
    prefix = "tessera_in_"

    def t(self, name: str) -> str:
        return self.prefix + name

    def sha(self, x: str) -> str:
        return f"sha2(cast({x} AS binary), 256)"

    def bytes(self, x: str) -> str:
        return f"cast(octet_length({x}) AS bigint)"

    def ms(self, ts: str) -> str:
        return f"unix_millis(cast({ts} AS timestamp))"

    def day(self, ts: str) -> str:
        return f"cast(dayofmonth({ts}) AS bigint)"

    def joined(self, x: str, by: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({by} AS k, {x} AS v))), s -> s.v), chr(0))"


class Duck:
    def t(self, name: str) -> str:
        return name

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def bytes(self, x: str) -> str:
        return f"cast(strlen({x}) AS bigint)"

    def ms(self, ts: str) -> str:
        return f"(epoch_us(cast({ts} AS timestamp)) // 1000)"

    def day(self, ts: str) -> str:
        return f"cast(dayofmonth({ts}) AS bigint)"

    def joined(self, x: str, by: str) -> str:
        return f"string_agg({x}, chr(0) ORDER BY {by}, {x})"


def field(d, x: str) -> str:
    return f"concat(cast({d.bytes(x)} AS varchar(20)), ':', {x})"


def text(x: str) -> str:
    return f"cast({x} AS varchar(20))"
