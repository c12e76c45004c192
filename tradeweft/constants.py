"""Public chain addresses, event topics, discriminators and thresholds.

They must equal the on-chain (or configured) values for results to be right.
"""

ZERO_ADDRESS = "0x0000000000000000000000000000000000000000"

# Quote tokens on Solana, most preferred quote first.
USDC = "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"
USDT = "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB"
USDS = "USDSwr9ApdHk5bvJKMjzff41FfuX8bSxdKcR81vTwcA"
SOL = "So11111111111111111111111111111111111111112"
USD_STABLECOINS = [USDC, USDT, USDS]
QUOTE_TOKENS = [USDC, USDT, USDS, SOL]

# The router whose transactions are left out of the Solana swap set.
EXCLUDED_ROUTERS = ["tuna4uSQZncNeeiAMKbstuxA9CUkHH6HmC64wgmnogD"]

# EVM event topics (keccak of the public event signatures).
TOPIC_TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TOPIC_SWAP = {
    "uniswap_v2": "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822",
    "uniswap_v3": "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67",
    "uniswap_v4": "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f",
    "aerodrome_basic": "0xb3e2773606abfd36b5bd91394b3a54d1398336c65005baf7bf7a05efeffaf75b",
    "aerodrome_slipstream": "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67",
}
TOPIC_POOL_CREATED = {
    "uniswap_v2": "0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9",
    "uniswap_v3": "0x783cca1c0412dd0d695e784568c96da2e9c22ff989357a2e8b1d9b2b4e6b7118",
    "uniswap_v4": "0xdd466e674ea557f56295e2d0218a125ea4b4f0f6f3307b95f85e6110838d6438",
    "aerodrome_basic": "0x2128d88d14c80cb081c1252a5acff7a264671bf199ce226b53788fb26065005e",
    "aerodrome_slipstream": "0xab0d57f0df537bb25e80245ef7748fa62353808c54d6e528a9dd20887aed9ac2",
}

# Pool factories per network as (dex, protocol, factory address).
FACTORIES = {
    "ethereum": [
        ("uniswap", "uniswap_v2", "0x5c69bee701ef814a2b6a3edd4b1652cb9cc5aa6f"),
        ("uniswap", "uniswap_v3", "0x1f98431c8ad98523631ae4a59f267346ea31f984"),
        ("uniswap", "uniswap_v4", "0x000000000004444c5dc75cb358380d2e3de08a90"),
        ("sushiswap", "uniswap_v2", "0xc0aee478e3658e2610c5f7a4a2e1777ce9e4f2ac"),
        ("sushiswap", "uniswap_v3", "0xbaceb8ec6b9355dfc0269c18bac9d6e2bdc29c4f"),
    ],
    "base": [
        ("uniswap", "uniswap_v2", "0x8909dc15e40173ff4699343b6eb8132c65e18ec6"),
        ("uniswap", "uniswap_v3", "0x33128a8fc17869897dce68ed026d694621f6fdfd"),
        ("uniswap", "uniswap_v4", "0x498581ff718922c3f8e6a244956af099b2652b2b"),
        ("sushiswap", "uniswap_v2", "0x71524b4f93c58fcbf659783284e38825f0622859"),
        ("sushiswap", "uniswap_v3", "0xc35dadb65012ec5796536bd9864ed8773abc74c4"),
        ("baseswap", "uniswap_v2", "0xfda619b6d20975be80a10332cd39b9a4b0faa8bb"),
        ("rocketswap", "uniswap_v2", "0x1b8128c3a1b7d20053d10763ff02466ca7ff99fc"),
        ("aerodrome", "aerodrome_basic", "0x420dd381b31aef6683db6b902084cb0ffece40da"),
        ("aerodrome", "aerodrome_slipstream", "0x5e7bb104d84c7cb9b682aac2f3d509f5f406809a"),
    ],
    "zora": [
        ("uniswap", "uniswap_v3", "0x7145f8aeef1f6510e92164038e1b6f8cb2c42cbb"),
        ("uniswap", "uniswap_v4", "0x0575338e4c17006ae181b47900a84404247ca30f"),
    ],
}

# Reference tokens per network as (token, pricing pool), most fundamental first.
REFERENCE_TOKENS = {
    "base": [
        ("0x833589fcd6edb6e08f4c7c32d4f71b54bda02913", "0xd0b53d9277642d899df5c87a3966a349a798f224"),
        (ZERO_ADDRESS, "0x96d4b53a38337a5733179751781178a2613306063c511b78cd02684739288c0a"),
        ("0x4200000000000000000000000000000000000006", "0xd0b53d9277642d899df5c87a3966a349a798f224"),
        ("0xcbb7c0000ab88b473b1f5afd9ef808440eed33bf", "0x70acdf2ad0bf2402c957154f944c19ef4e1cbae1"),
        ("0x0b3e328455c4059eeb9e3f84b5543f74e24e7e1b", "0xe31c372a7af875b3b5e0f3713b17ef51556da667"),
        ("0x940181a94a35a4569e4529a3cdfb74e38fd98631", "0x6cdcb1c4a4d1c3c6d054b27ac5b77e89eafb971d"),
        ("0x1111111111166b7fe7bd91427724b487980afc69", "0xedc625b74537ee3a10874f53d170e9c17a906b9c"),
        ("0x20dd04c17afd5c9a8b3f2cdacaa8ee7907385bef", "0x4cd15f2bc9533bf6fac4ae33c649f138cb601935"),
    ],
    "ethereum": [
        ("0xa0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", "0x88e6a0c2ddd26feeb64f039a2c41296fcb3f5640"),
        (ZERO_ADDRESS, "0x21c67e77068de97969ba93d4aab21826d33ca12bb9f565d8496e8fda8a82ca27"),
        ("0xc02aaa39b223fe8d0a0e5c4f27ead9083c756cc2", "0x88e6a0c2ddd26feeb64f039a2c41296fcb3f5640"),
        ("0x8d0d000ee44948fc98c9b98a4fa4921476f08b0d", "0x1e1dfff79d95725aaafd6b47af4fbc28d859ce28"),
    ],
    "zora": [
        ("0xcccccccc7021b32ebb4e8c08314bd62f7c653ec4", "0xbc59f8f3b275aa56a90d13bae7cce5e6e11a3b17"),
        ("0x4200000000000000000000000000000000000006", "0xbc59f8f3b275aa56a90d13bae7cce5e6e11a3b17"),
        ("0x078540eecc8b6d89949c9c7d5e8e91eab64f6696", "0x86c2fd1c99d8b7ff541767a4748b2eb38fd43da8"),
    ],
}

# Solana programs.
PROGRAM_TOKEN = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"
PROGRAM_TOKEN_2022 = "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb"
PROGRAM_METADATA = "metaqbxxUerdq28cj1RbAWkYQm3ybzjb6a8bt518x1s"
PROGRAM_LOADER = "BPFLoaderUpgradeab1e11111111111111111111111"
PROGRAM_AMM = {
    "orca_whirlpool": "whirLbMiicVdio4qvUfM5KAg6Ct8VwpYzGff3uctyCc",
    "meteora_damm": "Eo7WjKq67rjJQSZxS6z3YkapzY3eMj6Xy8X5EQVn5UaB",
    "meteora_dlmm": "LBUZKhRxPF3XUpBCjp4YzTKgLccjZhTSDM9YuVaPwxo",
    "raydium_clmm": "CAMMCzo5YL8w4VFF8KVHrK22GGUsp5VTaW7grrKgrWqK",
    "raydium_amm": "CPMMoo8L3F4NbTegBCKVNunggL7H1ZpdTHKxQB5qKP1C",
    "raydium_launchlab": "LanMV9sAd7wArD4vJFi2qDdfnVhFxYSUg6eADduJ3uj",
}

# First bytes (hex) of the swap instructions, per market maker type.
SWAP_D8 = {
    "orca_whirlpool": ["f8c69e91e17587c8"],
    "meteora_damm": ["f8c69e91e17587c8"],
    "meteora_dlmm": ["f8c69e91e17587c8", "fa49652126cf4bb8"],
    "raydium_clmm": ["f8c69e91e17587c8", "2b04ed0b1ac91e62", "457d73daf5baf2c4"],
    "raydium_amm": ["8fbe5adac41e33de", "37d96256a34ab4ad"],
    "raydium_launchlab": [
        "faea0d7bd59c13ec", "18d3742869039938", "9527de9bd37c981a", "5fc8472208090ba6"],
}
LAUNCHLAB_CREATE_CONFIG_D8 = "c9cff3724b6f2fbd"
LOADER_UPGRADE_D4 = "03000000"

# One-byte token program discriminators (hex).
D1_INITIALIZE_MINT = ["00", "14"]
D1_MINT = ["07", "0e"]
D1_BURN = ["08", "0f"]
D1_TRANSFER = "03"
D1_TRANSFER_CHECKED = "0c"
D1_TRANSFER_FEE = "1a"
D1_TRANSFER_HOOK = "24"
D1_CREATE_METADATA = ["00", "10", "21"]
D1_UPDATE_METADATA = ["01", "0f"]

# Program versions as (name, first block, transaction index in it).
PROGRAM_VERSIONS = {
    "orca_whirlpool": [("v1", 0, 0), ("v2", 361491090, 46)],
    "raydium_launchlab": [("v1", 0, 0), ("v2", 360865973, 1404)],
}

# Trading cost and decision configuration.
DEX_FEES = {
    "raydium": 0.0025, "orca": 0.003, "uniswap_v2": 0.003,
    "uniswap_v3": 0.0005, "sushiswap": 0.003, "aerodrome": 0.0005,
}
HORIZON_HOURS = {"new_tokens": 2, "emerging": 6, "established": 12, "blue_chip": 24}
# (bucket, min age days, max age days, min TVL, max TVL); bounds inclusive, first match wins.
LIQUIDITY_BUCKETS = [
    ("new_tokens", 0, 7, 0.0, 1e5),
    ("emerging", 7, 30, 1e5, 1e6),
    ("established", 30, 365, 1e6, 1e7),
    ("blue_chip", 365, 9999, 1e7, float("inf")),
]
UPSIDE_THRESHOLD = 0.008
DRAWDOWN_PROB_THRESHOLD = 0.4
ATR_STOP_MULTIPLE = 2.5
HARD_STOP = -0.05
