"""Functions of models, requests and money, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of model names and their providers, in the order in which they are tried.
PROVIDERS = (
    ("claude", "anthropic"),
    ("haiku", "anthropic"),
    ("sonnet", "anthropic"),
    ("opus", "anthropic"),
    ("gpt-", "openai"),
    ("o1", "openai"),
    ("o3", "openai"),
    ("o4", "openai"),
    ("gemini", "google"),
)
# Those of embedding models, tried after the others.
EMBEDDERS = (("text-embedding", "openai"), ("voyage", "voyage"))
# Owners of embedding models, in this very form, tried last.
EMBEDDER_OWNERS = (("BAAI/", "huggingface"), ("intfloat/", "huggingface"), ("sentence-transformers/", "huggingface"))
# The fallback rate, and the bounds within which a rate is taken.
RATE, LEAST_RATE, MOST_RATE = 23.5, 15.0, 40.0


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def provider(model, embeds: bool = False) -> Column:
    """The provider of a model by parts of its name, the first that fits; `unknown` otherwise."""
    name, out = F.lower(_column(model)), F.lit("unknown")
    for part, owner in reversed(EMBEDDER_OWNERS * embeds):
        out = F.when(F.contains(_column(model), F.lit(part)), F.lit(owner)).otherwise(out)
    for part, owner in reversed(PROVIDERS + EMBEDDERS * embeds):
        out = F.when(F.contains(name, F.lit(part)), F.lit(owner)).otherwise(out)
    return out


def client_address(peer, forwarded, trusted) -> Column:
    """The first forwarded address where the peer is trusted and there is one, else the peer."""
    first = F.nullif(F.trim(F.split(_column(forwarded), ",")[0]), F.lit(""))
    return F.when(trusted, F.coalesce(first, _column(peer))).otherwise(_column(peer))


def route_of(path, routes: list[str]) -> Column:
    """The first of the routes that the path starts with, else `default`."""
    out = F.lit("default")
    for route in reversed(routes):
        out = F.when(F.startswith(_column(path), F.lit(route)), F.lit(route)).otherwise(out)
    return out


def bounded_rate(rate) -> Column:
    """rate within its bounds, the fallback otherwise and for null."""
    return F.when(_column(rate).between(LEAST_RATE, MOST_RATE), _column(rate)).otherwise(F.lit(RATE))


def call_cost(tokens_in, tokens_out, cache_read, cache_write, price_in: float, price_out: float) -> Column:
    """Cost of a call at prices per million tokens; the cache is read at a tenth and written at five quarters."""
    i, o, r, w = map(_column, (tokens_in, tokens_out, cache_read, cache_write))
    return (i * price_in + o * price_out + r * price_in * 0.1 + w * price_in * 1.25) / 1e6


def embedding_cost(tokens, price: float) -> Column:
    return _column(tokens) * price / 1e6
