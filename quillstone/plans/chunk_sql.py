"""DuckDB SQL of the chunkers that carry state along a text: folds over its pieces."""

from __future__ import annotations

from quillstone.config import TokenChunkConfig

_WS = r"'^\s+|\s+$', '', 'g'"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, {_WS})"


def _tokens(x: str) -> str:
    return f"cast(ceil(length({x}) / 4.0) as int)"


def _tail(x: str, config: TokenChunkConfig) -> str:
    """What heads the chunk behind x."""
    size = config.overlap_tokens * 4
    last = f"substr({x}, length({x}) - {size - 1})"
    rest = f"regexp_extract({last}, '[^.]*$')"
    return f"(case when length({x}) <= {size} then '' when contains({last}, '.') and {rest} <> '' then trim({rest}, ' ' || chr(9)) else {last} end)"


def _state(**fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"


def _packed(source: str, name: str, config: TokenChunkConfig, joint: str, cost: int, alone: bool) -> str:
    """name: key, chunks (list of struct(x, a, b)) of source (key, pieces: list of struct(p, o))."""
    budget = config.max_tokens
    chunk = _state(x="s.content", a="s.a", b="s.b")
    closed = f"list_append(s.done, {chunk})"
    end = "(x.o + length(x.p)::int)"
    tail = _tail("s.content", config)
    headed = lambda t: f"(case when {t} <> '' then {t} || {joint} || x.p else x.p end)"
    single = f"{_tokens('x.p')} > {budget}" if alone else "false"
    before = f"(case when s.content <> '' then {tail} else s.tail end)"
    kept = f"(case when s.content <> '' then {closed} else s.done end)"
    step = f"""case
      when {single} then {_state(done=f"list_append({kept}, {_state(x=headed(before), a='x.o', b=end)})", content="''", a="s.a", b="s.b", tail=_tail('x.p', config))}
      when s.content <> '' and {_tokens('s.content')} + {_tokens('x.p')} + {cost} > {budget}
        then {_state(done=closed, content=headed(tail), a="x.o", b=end, tail=tail)}
      when s.content <> '' then {_state(done="s.done", content=f"s.content || {joint} || x.p", a="s.a", b=end, tail="s.tail")}
      else {_state(done="s.done", content=headed('s.tail'), a="x.o", b=end, tail="''")} end"""
    start = _state(done="[]::struct(x varchar, a int, b int)[]", content="''", a="0::int", b="0::int", tail="''")
    return f"""{name} as (select key, case when s.content <> '' then {closed} else s.done end as chunks
      from (select key, list_reduce(pieces, lambda s, x: {step}, {start}) as s from {source}))"""


def _pieces(source: str, name: str, parts: str, gap: int) -> str:
    """name: key, pieces (trimmed, with their places) of source (key, t); parts splits t, gap characters lie between its parts."""
    lead = r"length(x) - length(regexp_replace(x, '^\s+', ''))"
    return f"""{name}_0 as (select key, generate_subscripts(l, 1) as i, unnest(l) as x from (select key, {parts} as l from {source})),
    {name}_1 as (select key, i, x, sum(length(x) + {gap}) over (partition by key order by i) - length(x) - {gap} as o from {name}_0),
    {name} as (select key, list({_state(p=stripped('x'), o=f"cast(o + {lead} as int)")} order by i) as pieces from {name}_1 where {stripped('x')} <> '' group by key)"""


def token_chunks_sql(config: TokenChunkConfig, digest: str) -> str:
    """doc_id, chunk_index, estimated_tokens, start_offset, end_offset, content_hash; digest: the hash of {0}."""
    budget, least = config.max_tokens, config.least_tokens
    size, step = budget * 4, max(1, (budget - config.overlap_tokens) * 4)
    tidy = stripped(r"regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")
    slices = f"case when length(x) <= {size} then 1 else cast(ceil((length(x) - {size}) / {step}.0) as bigint) + 1 end"
    held = _state(x="s.x", a="s.a", b="s.b", n="s.n")
    out = f"(case when s.held then list_append(s.done, {held}) else s.done end)"
    nothing = {"x": "''", "a": "0::int", "b": "0::int", "n": "0::int", "held": "false"}
    merge = f"""case
      when s.held and s.n + x.n <= {budget} then {_state(done="s.done", x="s.x || chr(10) || chr(10) || x.x", a="s.a", b="x.b", n="s.n + x.n", held="true")}
      when x.n < {least} then {_state(done=out, x="x.x", a="x.a", b="x.b", n="x.n", held="true")}
      else {_state(done=f"list_append({out}, x)", **nothing)} end"""
    empty = _state(done="[]::struct(x varchar, a int, b int, n int)[]", **nothing)
    return rf"""with t as (select doc_id as key, t from (select doc_id, {tidy} as t from documents) where t <> ''),
    long as (select * from t where {_tokens('t')} > {budget}),
    {_pieces("long", "lines", "string_split(t, chr(10))", 1)},
    {_packed("lines", "packs", config, "chr(10) || chr(10)", 10, True)},
    c as (select key, generate_subscripts(chunks, 1) as i, unnest(chunks) as c from packs),
    large as (select key || '.' || i as key, c.x as t from c where {_tokens('c.x')} > {budget}),
    {_pieces("large", "sentences", r"regexp_extract_all(t, '[^.!?]*[.!?]*\s*')", 0)},
    {_packed("sentences", "parts", config, "' '", 2, False)},
    inner_ as (select key, generate_subscripts(chunks, 1) as j, unnest(chunks) as d from parts),
    finer as (select key, i, 0 as j, c.x as x, c.a as a, c.b as b from c where {_tokens('c.x')} <= {budget} union all
      select c.key, i, j, d.x, greatest(0, c.b - length(c.x) + d.a), greatest(0, c.b - length(c.x) + d.b) from c join inner_ on inner_.key = c.key || '.' || c.i),
    k as (select *, unnest(range(0, case when {_tokens('x')} <= {budget} then 1 else {slices} end)) * {step} as low from finer),
    cut as (select key, i, j, low, substr(x, low + 1, {size}) as y, case when {_tokens('x')} <= {budget} then a else greatest(0, b - length(x) + low) end as a,
      case when {_tokens('x')} <= {budget} then b else greatest(0, b - length(x) + low + length(substr(x, low + 1, {size}))) end as b from k),
    l as (select key, list({_state(x="y", a="cast(a as int)", b="cast(b as int)", n=_tokens('y'))} order by i, j, low) as cs from cut group by key),
    m as (select key, {out} as cs from (select key, list_reduce(cs, lambda s, x: {merge}, {empty}) as s from l)),
    u as (select key, generate_subscripts(cs, 1) - 1 as i, unnest(cs) as c from m union all
      select key, 0, {_state(x="t", a="0::int", b="length(t)::int", n=_tokens('t'))} from t where {_tokens('t')} <= {budget})
    select key as doc_id, cast(i as int) as chunk_index, c.n as estimated_tokens, c.a as start_offset, c.b as end_offset, {digest.format('c.x')} as content_hash from u"""
