"""Characters of symbol fonts as Unicode."""

from __future__ import annotations

#: Code points of symbol fonts that lists and forms use, by font and low byte.
SYMBOLS = {
    "symbol": {0xB7: "•", 0xB1: "±", 0xB3: "≥", 0xA3: "≤", 0xB9: "≠", 0xAE: "→", 0xAC: "←", 0x61: "α", 0x62: "β", 0x67: "γ", 0x64: "δ", 0x70: "π", 0x6D: "μ", 0x44: "Δ", 0x53: "Σ", 0xA5: "∞", 0xD6: "√", 0xB4: "×", 0xB8: "÷", 0xB0: "°"},
    "wingdings": {0xA7: "▪", 0xA8: "◻", 0xFC: "✓", 0xFB: "✗", 0xFE: "☑", 0x6F: "□", 0xD8: "➢", 0xE0: "→", 0xDF: "←", 0x6E: "■", 0x6C: "●", 0x76: "❖", 0x4A: "☺"},
}


def symbol(font: str, char: str) -> str:
    """The character that a font shows for a hexadecimal code: private codes by their low byte, others as they are."""
    try:
        code = int(char, 16)
    except ValueError:
        return ""
    known = SYMBOLS.get(font.lower(), {})
    low = code & 0xFF
    return known[low] if low in known and (code >= 0xF000 or code < 256) else chr(low) if 0xF000 <= code < 0xF100 else chr(code)
