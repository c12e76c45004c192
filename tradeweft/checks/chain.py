"""Checks of decoding, joins and market maker formulas on derived chain tables.

Log and instruction tables are encoded from the event table, so the SQL side knows the
decoded values without decoding.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tradeweft import constants as K
from tradeweft.checks.base import check
from tradeweft.functions import amm as A
from tradeweft.functions import hexwords as HX
from tradeweft.functions import num as N
from tradeweft.operators import decode_evm as DE
from tradeweft.operators import decode_solana as DS
from tradeweft.operators import enrich as EN
from tradeweft.operators import holders as HO
from tradeweft.operators import legs as LG
from tradeweft.operators import ordered as OR
from tradeweft.operators.dedup import union_protocols
from tradeweft.plans import chain as CH
from tradeweft.sources import scans as SC

_W = "lower(lpad(hex({0}), 64, CASE WHEN {0} < 0 THEN 'F' ELSE '0' END))"
_PAD = "concat('0x', lpad({0}, 64, '0'))"
_ADDR = "concat('0x', lpad(hex({0}), 40, '0'))"


def _w(expr: str) -> str:
    return _W.format(f"CAST({expr} AS BIGINT)")


def _topic(expr: str) -> str:
    return _PAD.format(f"lower(hex({expr}))")


def _log(t, topic0: str, topics: list[str], words: list[str], address: str = "concat('0xc', CAST(event_id % 12 AS STRING))", where: str = "true"):
    """A log table with one event per source row."""
    tops = ", ".join([f"'{topic0}'", *topics])
    return t.sql(f"""SELECT event_id AS block_number, CAST(ts AS TIMESTAMP) AS timestamp, {address} AS address, '{topic0}' AS topic0,
        array({tops}) AS topics, concat('0x', {', '.join(words)}) AS data, concat('0xtx', CAST(event_id AS STRING)) AS transaction_hash,
        CAST(event_id % 200 AS INT) AS transaction_index, CAST(event_id % 7 AS INT) AS log_index FROM {{e}} WHERE {where}""", e=t.table("events"))


_SENDER, _TO = _topic("user_id + 1"), _topic("event_id + 7")
_X, _Y = "(event_id * 1000003 + 17)", "(event_id * 7919 + 5)"


def _v2(t, protocol="uniswap_v2"):
    even = "event_id % 2 = 0"
    return _log(t, K.TOPIC_SWAP[protocol], [_SENDER, _TO], [
        _w(f"CASE WHEN {even} THEN {_X} ELSE 0 END"), _w(f"CASE WHEN {even} THEN 0 ELSE {_Y} END"),
        _w(f"CASE WHEN {even} THEN 0 ELSE {_X} END"), _w(f"CASE WHEN {even} THEN {_Y} ELSE 0 END")])


def _v3(t):
    return _log(t, K.TOPIC_SWAP["uniswap_v3"], [_SENDER, _TO], [
        _w(f"(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * {_X}"), _w(f"(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * {_Y}"),
        f"concat(repeat('0', 24), '1', substring({_w('event_id')}, 26, 39))", _w("event_id * 13"), _w("event_id % 401 - 200")])


def _v4(t):
    return _log(t, K.TOPIC_SWAP["uniswap_v4"], [_topic("event_id % 12 + 4096"), _SENDER], [
        _w(f"(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * {_X}"), _w(f"(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * {_Y}"),
        _w("event_id"), _w("event_id * 13"), _w("event_id % 401 - 200"), _w("3000")])


_SQL_ADDR = "'0x' || lpad(lower(to_hex({0})), 40, '0')"
_SND, _RCP = _SQL_ADDR.format("user_id + 1"), _SQL_ADDR.format("event_id + 7")
_AMT = f"if(event_id % 2 = 0, 1, -1) * {_X} AS amount_a_raw, if(event_id % 2 = 0, -1, 1) * {_Y} AS amount_b_raw"
_TXT = f"CAST(if(event_id % 2 = 0, 1, -1) * {_X} AS VARCHAR) AS amount_a_text, CAST(if(event_id % 2 = 0, -1, 1) * {_Y} AS VARCHAR) AS amount_b_text"
_COLS2 = ["block_number", "sender", "recipient", "amount_a_raw", "amount_b_raw", "amount_a_text", "amount_b_text"]
_V2SQL = f"SELECT event_id AS block_number, {_SND} AS sender, {_RCP} AS recipient, {_AMT}, {_TXT} FROM events"
check("p1_decode_v2_swaps", lambda t: DE.decode_v2_swaps(_v2(t)).select(*_COLS2), _V2SQL, "amount_a_raw amount_b_raw")
check("p2_decode_aerodrome_basic", lambda t: DE.decode_aerodrome_basic(_v2(t, "aerodrome_basic")).select(*_COLS2), _V2SQL, "amount_a_raw amount_b_raw")
check("p3_decode_v3_swaps", lambda t: DE.decode_v3_swaps(_v3(t)).select(*_COLS2, "pool_liquidity", "pool_tick", "pool_sqrt_price_x96"),
      f"""SELECT event_id AS block_number, {_SND} AS sender, {_RCP} AS recipient, {_AMT}, {_TXT}, CAST(event_id * 13 AS VARCHAR) AS pool_liquidity,
      event_id % 401 - 200 AS pool_tick, '91343852333181432387730302044767' || CAST(688728495783936 + event_id AS VARCHAR) AS pool_sqrt_price_x96 FROM events""",
      "amount_a_raw amount_b_raw", "pool_tick")
check("p4_decode_v4_swaps", lambda t: DE.decode_v4_swaps(_v4(t)).select(*_COLS2, "pool_id", "pool_tick"),
      f"""SELECT event_id AS block_number, {_SND} AS sender, CAST(NULL AS VARCHAR) AS recipient, {_AMT}, {_TXT},
      '0x' || lpad(lower(to_hex(event_id % 12 + 4096)), 64, '0') AS pool_id, event_id % 401 - 200 AS pool_tick FROM events""", "amount_a_raw amount_b_raw", "pool_tick")
check("u2_union_protocols", lambda t: DE.decode_swaps(union_protocols(_v2(t), _v2(t, "aerodrome_basic"), _v3(t), _v4(t)))
      .groupBy(F.col("protocols")[0].alias("protocol")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_b_raw").alias("amount_b")),
      f"SELECT p AS protocol, count(*) AS n, sum(if(event_id % 2 = 0, -1, 1) * {_Y}) AS amount_b FROM events, (SELECT unnest(['uniswap_v2','uniswap_v3','uniswap_v4','aerodrome_basic']) AS p) GROUP BY 1",
      "amount_b")


# Pool creations: one factory event per user, of five protocols by turn.
def _creations(t):
    f = {p: a for d, p, a in K.FACTORIES["base"] if d in ("uniswap", "aerodrome")}
    ta, tb, pool = _topic("user_id * 2 + 1"), _topic("user_id * 2 + 2"), _w("user_id + 500")
    spec = {
        "uniswap_v2": ([ta, tb], [pool, _w("1")]),
        "uniswap_v3": ([ta, tb, _topic("3000")], [_w("-60"), pool]),
        "uniswap_v4": ([_topic("user_id + 500"), ta, tb], [_w("500"), _w("10"), _w("0"), _w("0"), _w("0")]),
        "aerodrome_basic": ([ta, tb, _topic("user_id % 2")], [pool, _w("1")]),
        "aerodrome_slipstream": ([ta, tb, _topic("200")], [pool])}
    return union_protocols(*[_log(t, K.TOPIC_POOL_CREATED[p], tops, words, f"'{f[p]}'", f"user_id % 5 = {i}")
                             for i, (p, (tops, words)) in enumerate(spec.items())])


_POOLSQL = """pl AS (SELECT event_id AS block_number, user_id, ['uniswap_v2','uniswap_v3','uniswap_v4','aerodrome_basic','aerodrome_slipstream'][user_id % 5 + 1] AS protocol,
  '0x' || lpad(lower(to_hex(user_id + 500)), if(user_id % 5 = 2, 64, 40), '0') AS pool, '0x' || lpad(lower(to_hex(user_id * 2 + 1)), 40, '0') AS token_a,
  '0x' || lpad(lower(to_hex(user_id * 2 + 2)), 40, '0') AS token_b, CASE user_id % 5 WHEN 1 THEN -60 WHEN 2 THEN 10 WHEN 4 THEN 200 END AS tick_spacing,
  CASE user_id % 5 WHEN 1 THEN 3000 WHEN 2 THEN 500 END AS fee, CASE WHEN user_id % 5 = 3 THEN user_id % 2 = 1 END AS stable FROM events)"""
check("p5_decode_pools", lambda t: DE.decode_pools(_creations(t), "base").select(
      "block_number", "dex_name", "protocol", "pool", "token_a", "token_b", "tick_spacing", "fee", "stable"),
      f"""WITH {_POOLSQL}\nFINAL SELECT block_number, CASE WHEN user_id % 5 < 3 THEN 'uniswap' ELSE 'aerodrome' END AS dex_name, protocol, pool, token_a, token_b,
      tick_spacing, fee, stable FROM pl""", "", "tick_spacing fee")


def _transfer_logs(t):
    good = _log(t, K.TOPIC_TRANSFER, [_SENDER, _TO], [_w(_X)])
    nft = _log(t, K.TOPIC_TRANSFER, [_SENDER, _TO, _topic("event_id")], ["''"], where="event_id % 5 = 0")
    cut = _log(t, K.TOPIC_TRANSFER, [_SENDER, _TO], ["'00ff'"], where="event_id % 7 = 0")
    return union_protocols(good, nft, cut)


_TRSQL = f"SELECT event_id AS block_number, '0xc' || CAST(event_id % 12 AS VARCHAR) AS token, {_SND} AS from_address, {_RCP} AS to_address, {_X} AS amount FROM events"
_trc = ["block_number", "token", "from_address", "to_address", "amount"]
check("p6_decode_transfers", lambda t: DE.decode_transfers(_transfer_logs(t)).select(*_trc), _TRSQL, "", "amount")
check("s1_select_logs", lambda t: SC.select_logs(union_protocols(_v2(t), _v3(t)), [K.TOPIC_SWAP["uniswap_v3"]], ["0xC3", "0xc5"], (100, 9000)).select("block_number", "address"),
      "SELECT event_id AS block_number, '0xc' || CAST(event_id % 12 AS VARCHAR) AS address FROM events WHERE event_id % 12 IN (3, 5) AND event_id BETWEEN 100 AND 9000")
check("s2_select_transfer_logs", lambda t: DE.decode_transfers(SC.select_logs(_transfer_logs(t), [K.TOPIC_TRANSFER], ["0xc3"])).select(*_trc),
      _TRSQL + " WHERE event_id % 12 = 3", "", "amount")
check("s9_transfer_rows", lambda t: DE.decode_transfers(_transfer_logs(t)).groupBy("token", "sign").agg(F.sum("amount").alias("amount")),
      f"SELECT '0xc' || CAST(event_id % 12 AS VARCHAR) AS token, 1 AS sign, sum({_X}) AS amount FROM events GROUP BY 1", "", "sign amount")
check("f19_abi_string", lambda t: t.sql(f"""SELECT event_id, concat('0x', {_w('32')}, {_w('6')}, rpad(hex(concat('TK', CAST(event_id AS STRING))), 64, '0')) AS raw FROM {{e}}""",
      e=t.table("events")).select("event_id", HX.abi_string(F.col("raw")).alias("symbol")), "SELECT event_id, 'TK' || CAST(event_id AS VARCHAR) AS symbol FROM events")
check("f18_sort_accounts", lambda t: t.swaps.select("block_number", F.hex(HX.sort_accounts(F.unhex(F.md5(F.col("account").cast("binary"))),
      F.unhex(F.md5(F.col("pool_address").cast("binary"))))[0]).alias("first")),
      "SELECT block_number, upper(least(md5(account), md5(pool_address))) AS first FROM swaps")

# --- joins around swaps ------------------------------------------------------------------------------


def _txs(t):
    return t.sql("SELECT concat('0xtx', CAST(event_id AS STRING)) AS hash, concat('acc_', CAST(user_id AS STRING)) AS `from` FROM {e} WHERE event_id % 4 > 0", e=t.table("events"))


def _pools_dim(t):
    return t.sql("""SELECT DISTINCT 'base' AS network, 'uniswap' AS dex_name, CASE WHEN event_id % 12 < 6 THEN 'uniswap_v3' ELSE 'uniswap_v2' END AS protocol,
        concat('0xc', CAST(event_id % 12 AS STRING)) AS pool, concat('T', CAST(event_id % 12 % 3 AS STRING)) AS token_a, 'WETH' AS token_b, 'f' AS factory_address,
        60 AS tick_spacing, 3000 AS fee, CAST(NULL AS BOOLEAN) AS stable FROM {e} WHERE event_id % 12 <> 4""", e=t.table("events"))


def _tokens_dim(t):
    return t.sql("SELECT DISTINCT concat('T', CAST(event_id % 2 AS STRING)) AS address, CAST(6 + event_id % 2 AS INT) AS decimals, concat('S', CAST(event_id % 2 AS STRING)) AS symbol FROM {e}", e=t.table("events"))


_JP = "event_id % 12 < 6 AND event_id % 12 <> 4"
check("j1_with_tx", lambda t: EN.with_tx(_v3(t), _txs(t)).select("block_number", "account"),
      "SELECT event_id AS block_number, 'acc_' || CAST(user_id AS VARCHAR) AS account FROM events WHERE event_id % 4 > 0")
check("j2_j3_with_pool", lambda t: EN.with_pool(DE.decode_v3_swaps(_v3(t)), _pools_dim(t)).select("block_number", "pool_address", "protocol", "token_a"),
      f"""SELECT event_id AS block_number, '0xc' || CAST(event_id % 12 AS VARCHAR) AS pool_address, 'uniswap_v3' AS protocol,
      'T' || CAST(event_id % 12 % 3 AS VARCHAR) AS token_a FROM events WHERE {_JP}""")
check("j4_with_tokens", lambda t: EN.with_tokens(EN.with_pool(DE.decode_v3_swaps(_v3(t)), _pools_dim(t)), _tokens_dim(t)).select(
      "block_number", "token_a_symbol", "token_a_decimals", "amount_a", "token_b_symbol"),
      f"""SELECT event_id AS block_number, CASE WHEN k < 2 THEN 'S' || CAST(k AS VARCHAR) ELSE '' END AS token_a_symbol, CASE WHEN k < 2 THEN 6 + k END AS token_a_decimals,
      if(event_id % 2 = 0, 1, -1) * {_X} / pow(10.0, CASE WHEN k < 2 THEN 6 + k ELSE 18 END) AS amount_a, '' AS token_b_symbol
      FROM (SELECT *, event_id % 12 % 3 AS k FROM events WHERE {_JP})""", "amount_a", "token_a_decimals")
check("s6_only_pools", lambda t: CH.evm_swaps(_creations(t), _txs(t), "base", only_pools=True)["pools"].groupBy("protocol").agg(F.count_distinct("pool").alias("pools")),
      f"WITH {_POOLSQL}\nFINAL SELECT protocol, count(DISTINCT pool) AS pools FROM pl GROUP BY 1")


def _evm_logs(t):
    """Creations of two-token pools and swaps in them."""
    f = {p: a for d, p, a in K.FACTORIES["base"] if d == "uniswap"}
    made = _log(t, K.TOPIC_POOL_CREATED["uniswap_v3"], [_topic("user_id * 2 + 1"), _topic("user_id * 2 + 2"), _topic("3000")], [_w("60"), _w("user_id + 500")], f"'{f['uniswap_v3']}'")
    swap = _log(t, K.TOPIC_SWAP["uniswap_v3"], [_SENDER, _TO], [
        _w(f"(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * {_X}"), _w(f"(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * {_Y}"),
        _w("event_id"), _w("event_id"), _w("0")], f"lower({_ADDR.format('user_id + 500')})")
    return union_protocols(made, swap)


check("t10_pools_found_in_stream", lambda t: CH.evm_swaps(_evm_logs(t), _txs(t), "base", tokens=_tokens_dim(t))["swaps"].select(
      "block_number", "account", "pool_address", "dex_name", "token_a", "amount_b"),
      f"""SELECT event_id AS block_number, 'acc_' || CAST(user_id AS VARCHAR) AS account, {_SQL_ADDR.format('user_id + 500')} AS pool_address, 'uniswap' AS dex_name,
      {_SQL_ADDR.format('user_id * 2 + 1')} AS token_a, if(event_id % 2 = 0, -1, 1) * {_Y} / 1e18 AS amount_b FROM events WHERE event_id % 4 > 0""", "amount_b")

# --- Solana instructions --------------------------------------------------------------------------------
_LE = "reverse_bytes"


def _le(expr: str) -> str:
    h = f"lpad(hex(CAST({expr} AS BIGINT)), 16, '0')"
    return "concat(" + ", ".join(f"substring({h}, {15 - 2 * i}, 2)" for i in range(8)) + ")"


def _ins(t, program: str, data: str, accounts: list[str], path: str = "array(CAST(event_id % 5 AS INT))", where: str = "true"):
    acc = ", ".join(accounts)
    return t.sql(f"""SELECT event_id AS block_number, CAST(ts AS TIMESTAMP) AS timestamp, CAST(event_id % 200 AS INT) AS transaction_index, {path} AS instruction_address,
        '{program}' AS program_id, array({acc}) AS accounts, lower({data}) AS data, event_id % 13 > 0 AS is_committed,
        substring(lower({data}), 1, 2) AS d1, substring(lower({data}), 1, 8) AS d4, substring(lower({data}), 1, 16) AS d8 FROM {{e}} WHERE {where}""", e=t.table("events"))


_U = "concat('u', CAST(user_id AS STRING))"
_PO = "concat('v', CAST(event_id % 12 AS STRING))"


def _spl(t):
    plain = _ins(t, K.PROGRAM_TOKEN, f"concat('03', {_le(_X)})", [_U, _PO, "'own'"], where="event_id % 2 = 0")
    checked = _ins(t, K.PROGRAM_TOKEN_2022, f"concat('0c', {_le(_X)}, '06')", [_U, "'mint'", _PO, "'own'"], where="event_id % 2 = 1")
    return plain.unionByName(checked)


check("p7_decode_spl_transfers", lambda t: DS.decode_spl_transfers(_spl(t)).select("block_number", "source", "destination", "mint", "owner", "amount"),
      f"""SELECT event_id AS block_number, 'u' || CAST(user_id AS VARCHAR) AS source, 'v' || CAST(event_id % 12 AS VARCHAR) AS destination,
      if(event_id % 2 = 1, 'mint', NULL) AS mint, 'own' AS owner, {_X} AS amount FROM events""", "", "amount")


def _mint_ins(t):
    kinds = [("00", "init"), ("07", "mint"), ("0e", "mint"), ("08", "burn"), ("0f", "burn"), ("14", "init")]
    parts = [_ins(t, K.PROGRAM_TOKEN, f"concat('{d}', {'lpad(hex(CAST(event_id % 10 AS BIGINT)), 2, chr(48))' if k == 'init' else _le(_Y)}, '09')",
                  ["'burned'", _PO] if k == "burn" else [_PO, "'x'"], where=f"event_id % 6 = {i}") for i, (d, k) in enumerate(kinds)]
    return union_protocols(*parts)


check("p8_decode_mint_events", lambda t: DS.decode_mint_events(_mint_ins(t)).select("block_number", "kind", "mint", "decimals", "amount"),
      f"""SELECT event_id AS block_number, ['init','mint','mint','burn','burn','init'][event_id % 6 + 1] AS kind, 'v' || CAST(event_id % 12 AS VARCHAR) AS mint,
      CASE WHEN event_id % 6 IN (0, 5) THEN event_id % 10 END AS decimals, CASE WHEN event_id % 6 NOT IN (0, 5) THEN {_Y} END AS amount FROM events""", "", "decimals amount")
check("p9_program_version", lambda t: t.swaps.select("block_number", EN.program_version(F.col("block_number"), F.col("transaction_index"),
      [("v1", 0, 0), ("v2", 4000, 10), ("v3", 6007, 6)]).alias("version")),
      """SELECT block_number, CASE WHEN block_number > 6007 OR (block_number = 6007 AND transaction_index > 6) THEN 'v3'
      WHEN block_number > 4000 OR (block_number = 4000 AND transaction_index > 10) THEN 'v2' WHEN block_number > 0 OR transaction_index > 0 THEN 'v1' END AS version FROM swaps""")
check("p10_discriminator", lambda t: _spl(t).select("block_number", HX.discriminator(F.col("data"), 1).alias("d1"), HX.discriminator(F.col("data"), 4).alias("d4")).select(
      "block_number", "d1", F.length("d4").alias("n")), "SELECT event_id AS block_number, if(event_id % 2 = 0, '03', '0c') AS d1, 8 AS n FROM events", "", "n")


def _mixed(t):
    swap = _ins(t, K.PROGRAM_AMM["orca_whirlpool"], "'f8c69e91e17587c8ff'", [_U], where="event_id % 3 = 0")
    clmm = _ins(t, K.PROGRAM_AMM["raydium_clmm"], "'2b04ed0b1ac91e62ff'", [_U], where="event_id % 3 = 1")
    return union_protocols(swap, clmm, _mint_ins(t), _ins(t, K.PROGRAM_LOADER, "'0300000000'", ["'d'", _PO], where="event_id % 50 = 3"))


check("s3_select_instructions", lambda t: SC.select_instructions(_mixed(t), ["raydium_clmm"]).groupBy("program_id").agg(F.count(F.lit(1)).alias("n")),
      f"""SELECT program_id, count(*) AS n FROM (SELECT '{K.PROGRAM_AMM['raydium_clmm']}' AS program_id, event_id FROM events WHERE event_id % 3 = 1
      UNION ALL SELECT '{K.PROGRAM_TOKEN}', event_id FROM events UNION ALL SELECT '{K.PROGRAM_LOADER}', event_id FROM events WHERE event_id % 50 = 3)
      WHERE event_id % 13 > 0 GROUP BY 1""")
check("s3_only_meta", lambda t: SC.select_instructions(_mixed(t), only_meta=True).agg(F.count(F.lit(1)).alias("n")),
      "SELECT count(*) FILTER (event_id % 13 > 0) + count(*) FILTER (event_id % 13 > 0 AND event_id % 50 = 3) AS n FROM events")


def _token_balances(t):
    return t.sql("""SELECT event_id AS block_number, CAST(event_id % 200 AS INT) AS transaction_index, concat('v', CAST(event_id % 12 AS STRING)) AS account,
        CASE WHEN event_id % 5 > 0 THEN 'M' END AS pre_mint, CASE WHEN event_id % 6 > 0 THEN 'M' END AS post_mint,
        CASE WHEN event_id % 5 > 0 THEN CAST(event_id * 11 AS STRING) END AS pre_amount, CASE WHEN event_id % 6 > 0 THEN CAST(event_id * 13 AS STRING) END AS post_amount,
        CASE WHEN event_id % 5 > 0 THEN 6 END AS pre_decimals, CASE WHEN event_id % 6 > 0 THEN 6 END AS post_decimals FROM {e}""", e=t.table("events"))


check("s4_holder_balances", lambda t: SC.select_holder_balances(_token_balances(t), _mixed(t)).agg(F.count(F.lit(1)).alias("n"), F.min("block_number").alias("lo")),
      "SELECT count(*) AS n, min(event_id) AS lo FROM events WHERE event_id % 13 > 0")
check("p26_normalize_balances", lambda t: EN.normalize_balances(_token_balances(t)).select("block_number", "pre_amount", "post_amount", "has_pre", "has_post", "mint", "decimals"),
      """SELECT event_id AS block_number, CASE WHEN event_id % 5 > 0 THEN event_id * 11 END AS pre_amount, CASE WHEN event_id % 6 > 0 THEN event_id * 13 END AS post_amount,
      event_id % 5 > 0 AS has_pre, event_id % 6 > 0 AS has_post, CASE WHEN event_id % 30 > 0 THEN 'M' END AS mint, CASE WHEN event_id % 30 > 0 THEN 6 END AS decimals FROM events""", "", "decimals")
check("p23_decode_metadata", lambda t: DS.decode_metadata(t.sql(f"""SELECT event_id AS block_number, CAST(ts AS TIMESTAMP) AS timestamp, CAST(event_id % 200 AS INT) AS transaction_index,
      array(0) AS instruction_address, '{K.PROGRAM_METADATA}' AS program_id, CASE WHEN event_id % 2 = 0 THEN 'create' ELSE 'update' END AS kind,
      concat('md', CAST(user_id AS STRING)) AS metadata_acc, concat('m', CAST(user_id AS STRING)) AS mint,
      struct(concat('Name ', CAST(event_id AS STRING)) AS name, 'SYM' AS symbol, user_id % 2 = 0 AS is_mutable) AS args FROM {{e}}""", e=t.table("events"))).select(
      "block_number", "kind", "metadata_acc", "mint", "name", "symbol", "mutable"),
      """SELECT event_id AS block_number, if(event_id % 2 = 0, 'create', 'update') AS kind, 'md' || CAST(user_id AS VARCHAR) AS metadata_acc,
      CASE WHEN event_id % 2 = 0 THEN 'm' || CAST(user_id AS VARCHAR) END AS mint, 'Name ' || CAST(event_id AS VARCHAR) AS name, 'SYM' AS symbol,
      CASE WHEN event_id % 2 = 0 THEN user_id % 2 = 0 END AS mutable FROM events""")
check("p24_upgrade_alerts", lambda t: EN.upgrade_alerts(DS.decode_upgrades(_mixed(t)), t.sql("""SELECT concat('v', CAST(event_id % 12 AS STRING)) AS program_id,
      CASE WHEN event_id % 100 = 3 THEN event_id END AS block_number, CAST(event_id % 200 AS INT) AS transaction_index FROM {e} WHERE event_id % 50 = 3 AND event_id % 12 <> 5""",
      e=t.table("events"))).select("block_number", "program_id"),
      "SELECT event_id AS block_number, 'v' || CAST(event_id % 12 AS VARCHAR) AS program_id FROM events WHERE event_id % 50 = 3 AND event_id % 100 <> 3 AND event_id % 12 <> 5")
check("p25_nth_log", lambda t: OR.nth_row(t.sql("""SELECT floor(event_id / 3) AS tx, event_id % 3 AS log_index, user_id AS message FROM {e}""", e=t.table("events")), ["tx"], ["log_index"], 2).select(
      F.col("tx").cast("bigint").alias("tx"), "message"), "SELECT event_id // 3 AS tx, user_id AS message FROM events WHERE event_id % 3 = 1", "", "tx")


# Swap instructions with two inner transfers and an unrelated one.
def _swap_ins(t):
    return t.sql("""SELECT event_id AS block_number, CAST(event_id % 200 AS INT) AS transaction_index, array(CAST(event_id % 5 AS INT)) AS instruction_address,
        concat('u', CAST(user_id AS STRING)) AS user_in, concat('w', CAST(user_id AS STRING)) AS user_out, 'va' AS vault_a, 'vb' AS vault_b,
        CAST(100 + event_id % 7 AS DECIMAL(20,0)) AS amount_limit FROM {e}""", e=t.table("events"))


def _inner(t):
    e = t.table("events")
    at = "event_id AS block_number, CAST(event_id % 200 AS INT) AS transaction_index"
    first = t.sql(f"""SELECT {at}, array(CAST(event_id % 5 AS INT), 0) AS instruction_address, concat('u', CAST(user_id AS STRING)) AS source,
        CASE WHEN event_id % 2 = 0 THEN 'va' ELSE 'vb' END AS destination, 'own' AS owner, CAST(90 + event_id % 7 AS DECIMAL(20,0)) AS amount FROM {{e}}""", e=e)
    fee = t.sql(f"""SELECT {at}, array(CAST(event_id % 5 AS INT), 2) AS instruction_address, concat('u', CAST(user_id AS STRING)) AS source, 'fee' AS destination, 'own' AS owner,
        CAST(10 AS DECIMAL(20,0)) AS amount FROM {{e}} WHERE event_id % 11 > 0""", e=e)
    back = t.sql(f"""SELECT {at}, array(CAST(event_id % 5 AS INT), 1) AS instruction_address, CASE WHEN event_id % 2 = 0 THEN 'vb' ELSE 'va' END AS source,
        concat('w', CAST(user_id AS STRING)) AS destination, 'pool' AS owner, CAST(event_id % 50 + 1 AS DECIMAL(20,0)) AS amount FROM {{e}} WHERE event_id % 9 > 0""", e=e)
    other = t.sql(f"""SELECT {at}, array(9, 0) AS instruction_address, 'x' AS source, 'y' AS destination, 'own' AS owner, CAST(1 AS DECIMAL(20,0)) AS amount FROM {{e}}""", e=e)
    return union_protocols(first, fee, back, other)


check("j6_pair_swap_legs", lambda t: LG.pair_swap_legs(_swap_ins(t), _inner(t)).select(
      "block_number", F.col("leg_in.amount").alias("amount_in"), F.col("leg_out.amount").alias("amount_out"), F.col("leg_out.destination").alias("to")),
      """SELECT event_id AS block_number, 90 + event_id % 7 AS amount_in, if(event_id % 9 > 0, event_id % 50 + 1, 10) AS amount_out,
      if(event_id % 9 > 0, 'w' || CAST(user_id AS VARCHAR), 'fee') AS to FROM events WHERE event_id % 9 > 0 OR event_id % 11 > 0""")
check("j7_match_vault_legs", lambda t: LG.match_vault_legs(_swap_ins(t), _inner(t), True, None)[0].select(
      "block_number", F.col("leg_in.amount").alias("amount_in"), F.col("leg_out.amount").alias("amount_out"), "vault_out"),
      """SELECT event_id AS block_number, 90 + event_id % 7 AS amount_in, event_id % 50 + 1 AS amount_out, if(event_id % 2 = 0, 'vb', 'va') AS vault_out
      FROM events WHERE event_id % 9 > 0 AND event_id % 11 > 0""")
check("j7_match_vault_legs_errors", lambda t: LG.match_vault_legs(_swap_ins(t), _inner(t), True, None)[1].select("block_number", "reason"),
      """SELECT event_id AS block_number, if(event_id % 11 = 0, 'input sum', 'no output') AS reason FROM events WHERE event_id % 9 = 0 OR event_id % 11 = 0""")
check("j7_match_vault_legs_limit", lambda t: LG.match_vault_legs(_swap_ins(t), _inner(t), False, 1)[0].groupBy("vault_out").agg(F.count(F.lit(1)).alias("n"), F.sum("user_sum").alias("spent")),
      """SELECT if(event_id % 2 = 0, 'vb', 'va') AS vault_out, count(*) AS n, sum(90 + event_id % 7 + if(event_id % 11 > 0, 10, 0)) AS spent
      FROM events WHERE event_id % 9 > 0 GROUP BY 1""", "", "spent")


def _legs_checked(t):
    rows = LG.pair_swap_legs(_swap_ins(t), _inner(t))
    return LG.validate_legs(rows.withColumns({"vault_in": F.lit("va"), "vault_out": F.lit("vb")}))


check("j11_validate_legs", lambda t: _legs_checked(t)[0].select("block_number"), "SELECT event_id AS block_number FROM events WHERE event_id % 9 > 0 AND event_id % 2 = 0")
check("j11_validate_legs_bad", lambda t: _legs_checked(t)[1].select("block_number"),
      "SELECT event_id AS block_number FROM events WHERE (event_id % 9 > 0 OR event_id % 11 > 0) AND NOT (event_id % 9 > 0 AND event_id % 2 = 0)")
check("j9_with_reserves", lambda t: EN.with_reserves(t.sql("""SELECT event_id AS block_number, CAST(event_id % 200 AS INT) AS transaction_index,
      concat('v', CAST(event_id % 12 AS STRING)) AS vault_in, concat('v', CAST(event_id % 12 AS STRING)) AS vault_out FROM {e}""", e=t.table("events")),
      EN.normalize_balances(_token_balances(t))).select("block_number", "reserve_in", "reserve_out"),
      "SELECT event_id AS block_number, if(event_id % 5 > 0, event_id * 11, 0) AS reserve_in, if(event_id % 5 > 0, event_id * 11, 0) AS reserve_out FROM events")
check("j10_token_of_transfer", lambda t: LG.token_of_transfer(
      t.sql("""SELECT event_id AS block_number, CAST(event_id % 200 AS INT) AS transaction_index, array(0) AS transfer_address, 'none' AS source,
      concat('v', CAST(event_id % 12 AS STRING)) AS destination FROM {e} WHERE event_id % 30 > 0""", e=t.table("events")), _token_balances(t)).select("block_number", "mint", "decimals", "consistent"),
      "SELECT event_id AS block_number, 'M' AS mint, 6 AS decimals, true AS consistent FROM events WHERE event_id % 30 > 0", "", "decimals")
check("j5_with_token_meta", lambda t: EN.with_token_meta(t.swaps.select("block_number", "transaction_index", "token_a", "token_b"),
      t.sql("SELECT token_a AS mint, concat('S_', token_a) AS symbol, min(timestamp) AS created_at FROM {s} GROUP BY token_a", s=t.swaps),
      t.sql("SELECT token_a AS mint, block_number, 0 AS transaction_index, block_number * 2 AS issuance FROM {s} WHERE block_number % 100 = 5", s=t.swaps)).select(
      "block_number", "token_a_symbol", "token_b_symbol", "token_b_creation_date", "token_a_issuance"),
      """WITH d AS (SELECT token_a AS mint, 'S_' || token_a AS symbol, min(timestamp) AS created_at FROM swaps GROUP BY 1),
i AS (SELECT token_a AS mint, block_number AS b, block_number * 2 AS issuance FROM swaps WHERE block_number % 100 = 5)
FINAL SELECT s.block_number, da.symbol AS token_a_symbol, db.symbol AS token_b_symbol, db.created_at AS token_b_creation_date, i.issuance AS token_a_issuance
      FROM (SELECT *, block_number + if(transaction_index > 0, 0.5, 0) AS pos FROM swaps) s LEFT JOIN d da ON da.mint = s.token_a LEFT JOIN d db ON db.mint = s.token_b
      ASOF LEFT JOIN i ON i.mint = s.token_a AND i.b < s.pos""")
check("j21_with_curve", lambda t: EN.with_curve(t.swaps.select("block_number", F.col("pool_address").alias("global_config")),
      t.sql("SELECT DISTINCT pool_address AS account, CAST(substring(pool_address, 6) AS INT) % 3 AS curve_type FROM {s} WHERE pool_address <> 'pool_5'", s=t.swaps)).select("block_number", "curve_type"),
      "SELECT block_number, if(pool_address = 'pool_5', 0, CAST(substring(pool_address, 6) AS INT) % 3) AS curve_type FROM swaps", "", "curve_type")
check("t14_resume", lambda t: HO.after_checkpoint(t.swaps, (4321,), ["block_number"]).select("block_number"), "SELECT block_number FROM swaps WHERE block_number > 4321")

# --- market maker formulas --------------------------------------------------------------------------------
_E = lambda t, text: t.sql(text, e=t.table("events"))
check("f9_cp_exact_in", lambda t: _E(t, "SELECT event_id, event_id * 1000 + 77 AS a, 500000000000 + event_id AS ri, 900000000000 - event_id AS ro FROM {e}").select(
      "event_id", A.cp_exact_in(F.col("a"), F.col("ri"), F.col("ro")).alias("out"), A.slippage_exact_in(A.cp_exact_in(F.col("a"), F.col("ri"), F.col("ro")), F.col("a").cast("double")).alias("slip")),
      """SELECT event_id, o AS out, (o - a) / o * 100 AS slip FROM (SELECT event_id, a, CAST((CAST(a AS HUGEINT) * 9975 * ro) // (CAST(ri AS HUGEINT) * 10000 + CAST(a AS HUGEINT) * 9975) AS DOUBLE) AS o
      FROM (SELECT event_id, event_id * 1000 + 77 AS a, 500000000000 + event_id AS ri, 900000000000 - event_id AS ro FROM events))""", "out slip")
check("f10_cp_exact_out", lambda t: _E(t, "SELECT event_id, event_id * 1000 + 77 AS a, 500000000000 + event_id AS ri, 900000000000 - event_id AS ro FROM {e}").select(
      "event_id", A.cp_exact_out(F.col("a"), F.col("ri"), F.col("ro")).alias("into"), A.slippage_exact_out(F.col("a").cast("double"), A.cp_exact_out(F.col("a"), F.col("ri"), F.col("ro"))).alias("slip")),
      """SELECT event_id, o AS into, (a - o) / nullif(o, 0) * 100 AS slip FROM (SELECT event_id, a, CAST((CAST(ri AS HUGEINT) * a * 10000) // (CAST(ro - a AS HUGEINT) * 9975) AS DOUBLE) AS o
      FROM (SELECT event_id, event_id * 1000 + 77 AS a, 500000000000 + event_id AS ri, 900000000000 - event_id AS ro FROM events))""".replace(" AS into", ' AS "into"'), '"into" slip')
check("f11_sqrt_x64_price", lambda t: _E(t, "SELECT event_id, 18446744073709551616D + event_id * 1e15D AS x FROM {e}").select(
      "event_id", N.sqrt_x64_price(F.col("x"), F.lit(9), F.lit(6)).alias("price")),
      "SELECT event_id, pow((18446744073709551616.0::DOUBLE + event_id * 1e15) / pow(2.0, 64), 2) * 1000 AS price FROM events", "price")
check("f12_slippage_pre", lambda t: t.swaps.select("block_number", A.slippage_pre(F.abs("amount_a"), F.abs("amount_b"), F.lit(1.25), F.col("log_index") > 3).alias("s")),
      "SELECT block_number, (e - b) / e * 100 AS s FROM (SELECT block_number, abs(amount_b) AS b, if(log_index > 3, abs(amount_a) * 1.25, abs(amount_a) / 1.25) AS e FROM swaps)", "s")
check("f13_slippage_post", lambda t: t.swaps.select("block_number", A.slippage_post(F.abs("amount_a"), F.abs("amount_b"), F.lit(1.25), F.col("log_index") > 3).alias("s")),
      "SELECT block_number, (a - e) / e * 100 AS s FROM (SELECT block_number, abs(amount_a) AS a, if(log_index > 3, abs(amount_b) / 1.25, abs(amount_b) * 1.25) AS e FROM swaps)", "s")
check("f14_curve_price", lambda t: _E(t, "SELECT event_id, CAST(event_id % 3 AS INT) AS c, 1073000000000000 + event_id AS vb, 30000000000 + event_id AS vq, event_id * 1000 AS rb, event_id * 7 AS rq FROM {e}").select(
      "event_id", A.curve_price(F.col("c"), F.col("vb"), F.col("vq"), F.col("rb"), F.col("rq"), F.lit(9), F.lit(6)).alias("price"),
      A.curve_slippage(F.col("event_id") % 2 == 0, A.curve_paid_price(F.col("event_id") % 2 == 0, F.col("vq"), F.col("vb"), F.lit(1000), F.lit(9), F.lit(6)),
          F.when(F.col("event_id") % 2 == 0, 0.02).otherwise(3.5e7)).alias("slip")),
      """SELECT event_id, CASE c WHEN 0 THEN (vq + rq) / (vb - rb) WHEN 1 THEN vq / vb ELSE vb::DOUBLE * rb / pow(2.0, 64) END * 1e3 AS price,
      if(event_id % 2 = 0, 100, -100) * (if(event_id % 2 = 0, (vq - 1000) / vb, (vb + 1000) / vq) * 1000 / if(event_id % 2 = 0, 0.02, 3.5e7) - 1) AS slip
      FROM (SELECT event_id, event_id % 3 AS c, 1073000000000000 + event_id AS vb, 30000000000 + event_id AS vq, event_id * 1000 AS rb, event_id * 7 AS rq FROM events)""", "price slip")
