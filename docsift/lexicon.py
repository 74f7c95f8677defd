"""Rule tables. Order counts: the first entry that is met decides.

All values here are fixed: results depend on them.
"""

from __future__ import annotations

CATEGORIES = {
    "Structural": ["structural", "foundation", "wall", "ceiling", "floor", "beam", "column"],
    "Water Intrusion": ["water", "moisture", "damp", "wet", "leak", "flood", "humidity"],
    "Electrical": ["electrical", "wiring", "circuit", "breaker", "panel", "outlet", "switch"],
    "HVAC": ["hvac", "heating", "cooling", "ventilation", "ac", "furnace", "duct"],
    "Plumbing": ["plumbing", "pipe", "drain", "toilet", "sink", "faucet", "water heater"],
    "Foundation": ["foundation", "crack", "settlement", "sinking", "base"],
    "Roofing": ["roof", "shingle", "tile", "leak", "gutter", "downspout"],
    "Exterior": ["exterior", "siding", "paint", "deck", "porch", "fence", "landscaping"],
    "Interior": ["interior", "paint", "wallpaper", "flooring", "carpet", "tile"],
    "Safety": ["safety", "hazard", "danger", "risk", "fire", "carbon monoxide"],
}
REASONING_CATEGORIES = {
    "Structural": ["structural", "foundation", "wall", "roof", "beam", "column", "crack"],
    "Water Intrusion": ["water", "leak", "moisture", "damp", "wet", "flood", "humidity"],
    "Electrical": ["electrical", "wiring", "circuit", "panel", "outlet", "breaker"],
    "HVAC": ["hvac", "heating", "cooling", "ventilation", "duct", "furnace", "ac"],
    "Plumbing": ["plumbing", "pipe", "drain", "fixture", "water supply", "faucet"],
    "Roofing": ["roof", "shingle", "membrane", "flashing", "gutter", "ridge"],
    "Insulation": ["insulation", "thermal", "energy", "r-value", "attic"],
    "Safety": ["safety", "hazard", "danger", "emergency", "code violation"],
}
OTHER_CATEGORY = "General"
SEVERITIES = [("critical", "Critical", 1.0), ("high", "High", 0.8), ("medium", "Medium", 0.5), ("low", "Low", 0.2), ("info", "Information", 0.0), ("information", "Information", 0.0)]
CONFIDENCES = [("very high", "Very High", 1.0), ("high", "High", 0.8), ("moderate", "Moderate", 0.5), ("low", "Low", 0.2)]
SEVERITY_WORDS = [("critical", 1.0), ("severe", 0.9), ("danger", 0.9), ("risk", 0.8), ("significant", 0.7), ("moderate", 0.5), ("minor", 0.2), ("slight", 0.1)]
CATEGORY_WEIGHTS = {"Structural": 1.2, "Water Intrusion": 1.3, "Electrical": 1.4, "Safety": 1.5, "Foundation": 1.3}
SEVERITY_BANDS = [(0.8, "Critical"), (0.6, "High"), (0.4, "Medium"), (0.2, "Low")]
HEALTH_PENALTY = {"Critical": 20, "High": 10, "Medium": 5, "Low": 2}
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
LEVELS = ["Critical", "High", "Medium", "Low", "Information"]
STOP_WORDS = ["the", "a", "an", "of", "for", "on", "at", "to", "with", "without"]
CAUSES = [("Water Intrusion", "Structural"), ("Water Intrusion", "Foundation"), ("Structural", "Safety"), ("Electrical", "Safety")]
CONTRADICTIONS = [
    ("moisture", ["dry", "no water", "no moisture"]),
    ("damage", ["no damage", "undamaged", "intact"]),
    ("crack", ["no crack", "solid", "no structural issues"]),
    ("leak", ["no leak", "sealed", "waterproof"]),
]
TEMPLATES = {
    ("Structural", "Critical"): "Immediately engage structural engineer for emergency assessment",
    ("Structural", "High"): "Schedule structural assessment within 48 hours",
    ("Structural", "Medium"): "Monitor structural conditions weekly",
    ("Structural", "Low"): "Document structural observations for future reference",
    ("Water Intrusion", "Critical"): "Emergency water extraction and remediation required",
    ("Water Intrusion", "High"): "Professional water damage restoration needed",
    ("Water Intrusion", "Medium"): "Install dehumidifiers and monitor moisture levels",
    ("Water Intrusion", "Low"): "Improve ventilation and check for leaks",
}
ACTION_PRIORITY = [("Critical", "Immediate", 0), ("High", "Short-Term", 1), ("Medium", "Long-Term", 2), ("Low", "Preventive", 3)]
PRIORITY_RANK = {"immediate": 0, "Immediate": 0, "short-term": 1, "Short-Term": 1, "Short-term": 1, "long-term": 2, "Long-Term": 2, "Long-term": 2, "preventive": 3, "Preventive": 3}
PRIORITY_WORDS = [(("immediate", "urgent", "emergency"), "Immediate"), (("short", "soon", "next"), "Short-Term"), (("long", "future", "plan"), "Long-Term")]
STRATEGIES = ["Implement regular preventive maintenance schedule", "Monitor and document all property conditions", "Establish emergency response protocols", "Maintain comprehensive property documentation"]
MAGIC = [(b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpg"), (b"BM", "bmp"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"RIFF", "webp")]
SUSPICIOUS = ["<script", "<?php", "<%", "javascript:", "onerror=", "onload=", "eval(", "exec("]
NO_SUMMARY = "No property summary provided. Please refer to observations below."
NO_ROOT_CAUSE = "Unable to determine root cause from available data."
NOTHING_MISSING = "No missing information identified."
NO_OBSERVATIONS = "No observations available."
FAILED_SUMMARY = "Unable to generate a property summary — all AI providers failed during processing. No observations were extracted from the source documents. See processing_metadata.errors for details."
FAILED_OVERVIEW = "AI analysis could not be completed — all configured providers failed during processing. See processing_metadata.errors for details."
ERROR_STATUS = [
    ("PDF_VALIDATION_ERROR", 422), ("FILE_SIZE_LIMIT_EXCEEDED", 422), ("INVALID_FILE_TYPE", 422), ("MAGIC_BYTE_MISMATCH", 422), ("EMPTY_FILE", 422), ("PDF_EXTRACTION_ERROR", 422), ("EMPTY_EXTRACTION", 422),
    ("AI_PROCESSING_ERROR", 502), ("DDR_GENERATION_ERROR", 500), ("REPORT_GENERATION_ERROR", 500), ("STORAGE_ERROR", 507), ("INTERNAL_ERROR", 500), ("RATE_LIMITED", 429),
]
RETENTION = {"temp": "24 HOURS", "report": "30 DAYS", "image": "7 DAYS"}
SECTION_ISSUES = ["Missing property summary", "No area observations provided", "No recommendations provided"]
