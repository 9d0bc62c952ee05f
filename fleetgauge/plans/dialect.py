"""Spelling differences between Spark SQL and the checking engine, for the input bindings."""

from __future__ import annotations


class SparkSpelling:
    name = "spark"

    def us(self, ts):
        return f"unix_micros(cast({ts} as timestamp))"

    def plus_s(self, ts, n):
        return f"timestampadd(SECOND, cast({n} as bigint), {ts})"

    def plus_us(self, ts, n):
        return f"timestampadd(MICROSECOND, cast({n} as bigint), {ts})"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def whole(self, x):
        return f"cast(floor({x}) as bigint)"

    def arr(self, *xs):
        return f"array({', '.join(xs)})"

    def ntz(self, text):
        return f"timestamp_ntz'{text}'"

    def sorted_list(self, x):
        return f"array_sort(collect_list({x}))"


class CheckSpelling(SparkSpelling):
    name = "check"

    def us(self, ts):
        return f"epoch_us({ts})"

    def plus_s(self, ts, n):
        return f"({ts} + to_seconds(cast({n} as bigint)))"

    def plus_us(self, ts, n):
        return f"({ts} + to_microseconds(cast({n} as bigint)))"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def arr(self, *xs):
        return f"[{', '.join(xs)}]"

    def ntz(self, text):
        return f"timestamp '{text}'"

    def sorted_list(self, x):
        return f"list({x} order by {x})"
