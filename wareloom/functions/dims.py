"""Vocabularies. Fixed values."""

CATEGORIES: dict[str, list[str]] = {
    "handwoven-textiles": ["saree", "sari", "handloom", "khadi", "dupatta", "stole", "shawl", "ikat", "kalamkari", "block print", "weave", "woven", "pashmina", "fabric", "textile"],
    "apparel": ["kurta", "kurti", "shirt", "dress", "blouse", "trouser", "jacket", "apparel", "clothing", "wear"],
    "jewellery": ["jewellery", "jewelry", "silver", "gold", "kundan", "meenakari", "temple jewellery"],
    "leather-bags": ["bag", "leather", "tote", "satchel", "clutch", "wallet", "purse", "backpack", "sling"],
    "more-crafts": [],
}
SHELVES = {
    "handwoven-textiles/sarees": ["saree", "sari", "kanjivaram", "banarasi", "chanderi", "tussar", "dola silk"],
    "handwoven-textiles/dupattas-stoles": ["dupatta", "stole", "shawl", "odhni", "chunni"],
    "handwoven-textiles/home-textiles": ["cushion", "bedsheet", "bedcover", "quilt", "razai", "throw", "table runner", "napkin", "curtain", "durrie", "rug"],
    "handwoven-textiles/fabric-by-the-metre": ["fabric", "yardage", "running metre", "per metre", "by the metre", "cloth"],
    "apparel/mens-fashion": ["men", "mens", "kurta pyjama", "nehru jacket", "sherwani", "dhoti"],
    "apparel/womens-fashion": ["women", "womens", "kurti", "kurta", "saree blouse", "lehenga", "salwar", "anarkali"],
    "apparel/kids": ["kids", "child", "children", "baby", "infant", "toddler", "boys", "girls"],
    "jewellery/necklaces": ["necklace", "choker", "haar", "mala", "chain"],
    "jewellery/earrings": ["earring", "jhumka", "jhumki", "stud", "hoop", "chandbali", "danglers"],
    "jewellery/rings": ["ring", "band", "signet"],
    "jewellery/jewellery-sets": ["jewellery set", "jewelry set", "bridal set", "necklace set", "parure"],
    "jewellery/loose-gemstones": ["gemstone", "loose stone", "carat", "cabochon", "rough stone", "uncut"],
    "jewellery/pendants": ["pendant", "locket", "charm"],
    "leather-bags/handbags": ["handbag", "tote", "satchel", "clutch", "sling", "shoulder bag", "backpack", "potli"],
    "leather-bags/wallets-small-goods": ["wallet", "cardholder", "card holder", "coin purse", "pouch", "passport cover", "key ring"],
    "leather-bags/belts-accessories": ["belt", "strap", "buckle", "braces", "suspender"],
}
FALLBACK_CATEGORY = "more-crafts"
HS_BY_MATERIAL = {
    "jewellery": {"925": "7113", "sterling silver": "7113", "solid gold": "7113", "imitation": "7117", "artificial": "7117",
                  "oxidised": "7117", "oxidized": "7117", "brass": "7117", "german silver": "7117"},
    "handwoven-textiles": {"pure silk": "5007", "mulberry silk": "5007", "tussar": "5007", "kanjivaram": "5007", "banarasi": "5007"},
}
HS_BY_SHELF = {
    "handwoven-textiles/sarees": "5007", "handwoven-textiles/dupattas-stoles": "6214",
    "handwoven-textiles/home-textiles": "6304", "handwoven-textiles/fabric-by-the-metre": "5007",
}
HS_BY_CATEGORY = {"apparel": "6206", "jewellery": "7113", "leather-bags": "4202"}
POLICY = {
    "antiquities": ["antique", "antiquity", "vintage", "over 100 years", "100 years old", "colonial era", "colonial-era", "pre-independence", "heirloom", "excavated", "archaeological"],
    "wildlife": ["ivory", "tusk", "bone", "shell", "tortoise", "turtle", "peacock feather", "peacock", "fur", "exotic leather", "python", "crocodile", "alligator", "snakeskin", "shahtoosh", "coral", "elephant hair"],
    "weapons": ["knife", "knives", "blade", "dagger", "sword", "katar", "kirpan", "firearm", "ammunition", "bullet", "gun", "machete", "axe"],
    "gi_claim": ["gi tag", "gi-tag", "g.i. tag", "geographical indication", "gi certified", "gi registered", "certified", "authentic", "genuine", "registry"],
}
#: reason: (class, retryable)
REASONS = {
    "robots_disallowed": ("refused", False), "blocked_403": ("refused", False), "blocked_429": ("refused", True),
    "bot_challenge": ("refused", False), "sign_in_required": ("refused", False), "timeout_connect": ("failed", True),
    "timeout_read": ("failed", True), "dns_failure": ("failed", False), "http_error_5xx": ("failed", True),
    "not_a_product_page": ("failed", False), "no_extractable_content": ("failed", False),
    "no_image_candidates": ("failed", False), "all_candidates_rejected": ("failed", False),
    "host_upload_failed": ("failed", True), "hosting_blocked_third_party": ("refused", False),
    "browser_unavailable": ("failed", False),
}
