"""The published rules that tie a step's opening words to its label."""

from __future__ import annotations

# Labels, and patterns over texts without points, as (pattern, expected label, name). Order counts.
CHALLENGE, RESOLUTION, STATEMENT = "קשיא", "תירוץ", "מימרא"
SOURCE_RULES = (
    (r"^\s*למה\s*לי", CHALLENGE, "למה לי redundancy attack"),
    (r"^\s*ליתני\s+חדא", CHALLENGE, "ליתני חדא redundancy attack"),
    (r"^\s*וליתני\s", CHALLENGE, "וליתני redundancy attack"),
    (r"^\s*ומי\s*מצית\s*אמרת", CHALLENGE, "ומי מצית אמרת counter-attack"),
    (r"^\s*והא\s.*קאמר", CHALLENGE, "והא X קאמר counter-attack"),
    (r"^\s*אי\s*תנא", RESOLUTION, "אי תנא X הוה אמינא resolution"),
    (r"^\s*לא,\s*דאמר\s*ליה", RESOLUTION, "לא דאמר ליה recasting"),
    (r"^\s*לא,\s*ב", RESOLUTION, "לא ב recasting"),
    (r"^\s*חדא\s*קתני", RESOLUTION, "חדא קתני resolves redundancy"),
    (r"^\s*ואידך[:\s]", STATEMENT, "ואידך alternative view"),
    (r"^\s*ואידך\s*סבר", STATEMENT, "ואידך סבר alternative view"),
    (r"^\s*וצריכא\s*[:.]?\s*$", STATEMENT, "וצריכא alone (transition)"),
    (r"^\s*וצריכי\s*[:.]?\s*$", STATEMENT, "וצריכי alone (transition)"),
)
AUDIT_RULES = (
    (r'^\s*תא\s*שמע|^\s*ת"ש', CHALLENGE, "תא שמע citing source as challenge"),
    (r"^\s*תני |^\s*תניא|^\s*תנו\s*רבנן", None, "תניא/תנו רבנן (could be מימרא if standalone, but flag for review)"),
    (r"^\s*לא, דאמר|^\s*לא,\s+ב", RESOLUTION, "לא, [different case] resolving difficulty"),
    (r"^\s*ואידך", STATEMENT, "ואידך stating alternative view"),
    (r"^\s*וצריכא", STATEMENT, "וצריכא asserting necessity"),
    (r"^\s*למה\s*לי|^\s*וליתני|^\s*ליתני\s+חדא", CHALLENGE, "redundancy attack on wording"),
    (r"^\s*אי\s*תנא", RESOLUTION, "אי תנא X הוה אמינא… (תירוץ pattern)"),
    (r"^\s*והא", CHALLENGE, "והא [contradiction]"),
    (r"^\s*ומי\s*מצית", CHALLENGE, "ומי מצית — challenging the previous interpretation"),
)
