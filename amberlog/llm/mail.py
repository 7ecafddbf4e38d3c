"""The writer's own part of a raw mail: encodings undone, without headers, greeting, signature, disclaimer, quoted mail and attachments.

Plain string work on one text at a time; whatever is broken (unclosed parts, lost headers, bad encodings) is read as far as it goes.
"""

from __future__ import annotations

import base64
import binascii
import html
import re

#: Names of mail headers; a block of lines is a head only if every line has one of these names.
_NAMES = (
    r"(?:From|To|Cc|Bcc|Subject|Date|Message-Id|Received|MIME-Version|Content-[a-z-]+|Reply-To|In-Reply-To|References|Return-Path|Sender|Delivered-To|"
    r"Importance|Priority|Precedence|User-Agent|Organization|Errors-To|Status|Lines|Newsgroups|Path|Thread-[a-z-]+|Auto-Submitted|DKIM-Signature|ARC-[a-z-]+|Authentication-Results|List-[a-z-]+|X-[a-z0-9-]+)"
)
_HEADER = re.compile(rf"(?:From \S[^\n]*\n|{_NAMES}:[^\n]*(?:\n|\Z)(?:[ \t]+[^\n]*\n)*)+", re.I)
_FIELD = re.compile(r"^([A-Za-z-]+):[ \t]*((?:[^\n]|\n[ \t]+)*)", re.M)
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_LOOSE_PART = re.compile(r"(?:\A|\n)--(\S[^\n]*)\nContent-", re.I)
_BREAK = re.compile(r"<br\s*/?>\n?|</(?:p|div|tr|li|h[1-6]|table|ul|ol|blockquote)\s*>\n?", re.I)
_CELL = re.compile(r"</t[dh]\s*>\s*(?=<t[dh])", re.I)
_ITEM = re.compile(r"<li[^>]*>", re.I)
_HIDDEN = re.compile(r"<(style|script|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_MARKUP = re.compile(r"^[ \t]*<(?:!doctype|html|body|div|p|table|tr|ul|ol)\b[^<>\n]*>", re.I | re.M)
_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_ORIGINAL = re.compile(r"^[ \t]*-{2,}[ ]?[^\n-]{4,60}?[ ]?-{2,}[ \t]*\n+(?=(?:From|Von|De|От|Від|Da|Sent|Date|Subject)\b[^\n]*:)", re.M | re.I)
_SAYS = re.compile(r"\d.*:[ \t]*$")
_POSTMARK = re.compile(r"\AFrom \S+@\S+ [^\n]*\n")
_SIGNATURE = re.compile(r"^-- ?\n", re.M)
_RULE = re.compile(r"^[ \t]*(?:_{5,}|-{5,}|={5,}|\*{3,}|~{5,})[ \t]*\n(?=[ \t]*[^\W\d_][^\n|;\t]{20,})", re.M)
_BLANK = re.compile(r"\n[ \t]*\n")
#: How closing lines begin, and greetings.
CLOSINGS = (
    "regards", "best wishes", "best regards", "kind regards", "thanks", "thank you", "cheers", "sincerely", "yours", "с уважением", "спасибо", "всего доброго", "з повагою", "дякую", "щиро",
    "mit freundlichen grüßen", "viele grüße", "freundliche grüße", "mit besten grüßen", "danke", "grüße", "cordialement", "merci", "bien à vous", "amicalement", "un saludo", "saludos", "gracias", "atentamente",
    "cordiali saluti", "saluti", "grazie", "un saluto", "distinti saluti", "bien cordialement", "beste grüße", "liebe grüße", "con gratitudine", "до побачення", "до свидания",
)
#: What a disclaimer speaks of, in word beginnings: the message, whom it is for or from, mistakes and what to do then, views and liability.
DISCLAIMER_TOPICS = (
    ("message", "mail", "e-mail", "email", "letter", "communication", "письм", "сообщени", "лист", "повідомлен", "nachricht", "courriel", "courrier", "mensaje", "correo", "carta", "messaggi", "lettera"),
    (
        "addressed", "addressee", "intended", "recipient", "sender", "writer", "author", "confidential", "privileged", "адресат", "отправител", "получател", "автор", "конфиденциальн", "одержувач", "відправник",
        "конфіденційн", "empfänger", "absender", "verfasser", "vertraulich", "destinataire", "expéditeur", "auteur", "confidentiel", "destinatario", "remitente", "autor", "confidencial", "mittente", "riservat",
    ),
    (
        "mistake", "error", "delete", "remove", "destroy", "copies", "copy", "print", "ошибк", "удалит", "копии", "помилк", "видал", "копії", "irrtüm", "versehentlich", "löschen", "kopien", "erreur", "effacez",
        "supprimez", "copie", "error", "borre", "elimin", "copia", "errore", "cancell",
    ),
    ("views", "opinion", "liable", "liability", "bind", "мнени", "ответственност", "погляд", "відповідальн", "ansicht", "meinung", "haftung", "avis", "responsab", "opinione", "opiniones"),
)
GREETINGS = (
    "hello", "hi", "dear", "good morning", "good afternoon", "good evening", "здравствуйте", "добрый день", "доброе утро", "привет", "уважаем", "добрий день", "вітаю", "привіт", "доброго", "hallo", "guten", "liebe", "sehr geehrte",
    "bonjour", "salut", "cher", "chère", "bonsoir", "hola", "buenos", "buenas", "estimad", "querid", "ciao", "buongiorno", "gentile", "buonasera", "salve", "caro", "cara",
)


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        kept = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            data = base64.b64decode(kept[: len(kept) // 4 * 4] + (kept[len(kept) // 4 * 4 :] + "===")[: 4 if len(kept) % 4 > 1 else 0])
        except (binascii.Error, ValueError):
            return body
    elif encoding == "quoted-printable":
        data = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return data.decode(charset or "utf-8", "replace").replace("\r\n", "\n")
    except LookupError:
        return data.decode("utf-8", "replace").replace("\r\n", "\n")


def _plain(markup: str) -> str:
    if "<" not in markup:
        return html.unescape(markup)
    text = _HIDDEN.sub("", markup) if "<s" in markup or "<!--" in markup or "<head" in markup else markup
    text = _ITEM.sub("- ", _CELL.sub("\t", text)) if "<t" in text or "<li" in text else text
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))


def _split(text: str) -> tuple[dict[str, str], str]:
    """(headers in lower case, body) of a mail or a part; without headers all is body."""
    m = _HEADER.match(text)
    if not m:
        return {}, _POSTMARK.sub("", text)
    rest = text[m.end() :]
    return {k.lower(): v for k, v in _FIELD.findall(m[0])}, rest.removeprefix("\n")


def _leaf(head: dict[str, str], body: str) -> tuple[str, str]:
    kind = head.get("content-type", "").lower()
    charset = re.search(r"charset\s*=\s*\"?([\w-]+)", kind)
    decoded = _decoded(body, head.get("content-transfer-encoding", "").strip().lower(), charset[1] if charset else "utf-8")
    markup = kind.startswith("text/html") or ("<" in decoded and _MARKUP.search(decoded) is not None)
    return ("html", _plain(decoded)) if markup else ("plain", decoded)


def _texts(text: str) -> list[tuple[str, str]]:
    """[(kind, text)] of the readable parts of a mail: kind is plain or html; attachments are left out.  Parts may lie in parts to any depth."""
    out: list[tuple[str, str]] = []
    # a task reads a part (its text), or ends the part whose texts begin at a place of ``out``: (place, only plain ones are wanted, what stands for none)
    stack: list = [text]
    while stack:
        what = stack.pop()
        if isinstance(what, tuple):
            begin, alternative, instead = what
            if alternative and any(k == "plain" and t.strip() for k, t in out[begin:]):
                out[begin:] = [x for x in out[begin:] if x[0] == "plain"]
            if len(out) == begin and instead is not None:
                out.append(("plain", instead))
            continue
        head, body = _split(what)
        kind = head.get("content-type", "").lower()
        if "attachment" in head.get("content-disposition", "").lower() or kind.startswith(("application/", "image/", "audio/", "video/")):
            continue
        found = _BOUNDARY.search(head.get("content-type", "")) if kind.startswith("multipart") else None
        mark = (found[1] or found[2]) if found else None
        if mark is None and (loose := _LOOSE_PART.search(body)):
            mark = loose[1].rstrip()
        if mark is None or f"--{mark}" not in body:
            out.append(_leaf(head, body))
            continue
        pieces = ("\n" + body).split(f"\n--{mark}")
        stack.append((len(out), kind.startswith("multipart/alternative"), None if what is not text else pieces[0]))
        stack += [p.lstrip(" \t").removeprefix("\n") for p in reversed(pieces[1:]) if not p.startswith("--")]
    return out


def readable(text: str) -> str:
    """The readable text of a raw mail: of plain and HTML forms of the same, the plain one."""
    parts = _texts(text.replace("\r\n", "\n").replace("\r", "\n"))
    plain = [t for k, t in parts if k == "plain" and t.strip()]
    return "\n\n".join(plain or [t for _, t in parts])


def _unquoted(s: str) -> str:
    """Without quoted lines and the line (or two) that says who wrote them."""
    out: list[str] = []
    quoted = False
    for line in s.split("\n"):
        bar = line.startswith("|") and not line.rstrip().endswith("|", 1) and (quoted or bool(out) and _SAYS.search(out[-1]) is not None)
        if bar or line.lstrip(" \t").startswith(">"):
            if not quoted:
                k = len(out) - 1
                while k >= 0 and not out[k].strip():
                    k -= 1
                if k >= 0 and out[k].rstrip().endswith(":"):
                    wrapped = not any(c.isdigit() for c in out[k]) and k and any(c.isdigit() for c in out[k - 1])
                    del out[k - 1 if wrapped else k :]
            quoted = True
        else:
            quoted = quoted and not line.strip()
            out.append(line)
    return "\n".join(out)


def _is_greeting(paragraph: str) -> bool:
    line = paragraph.strip()
    if "\n" in line or len(line) > 60 or line[-1:] not in (",", "!", ":", "."):
        return False
    words = line.lower()
    return words.startswith(GREETINGS) or words.rstrip("!., ").endswith(GREETINGS)


def _is_disclaimer(paragraph: str) -> bool:
    """Whether a paragraph speaks of three of the topics of disclaimers, or of two below a rule."""
    words = [w for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", paragraph.lower())]
    return sum(any(w.startswith(topic) for w in words) for topic in DISCLAIMER_TOPICS) >= (2 if _RULE.match(paragraph.lstrip("\n")) else 3)


def _without_end(s: str) -> str:
    """Without the disclaimers, the signature and the closing it ends with; unchanged if nothing else is there."""
    kept = s.rstrip()
    while kept:
        at = max((x.end() for x in _BLANK.finditer(kept)), default=0)
        first, _, rest = kept[at:].lstrip("\n").partition("\n")
        closing = len(first) < 40 and first.strip().lower().startswith(CLOSINGS)
        if not (closing or first.rstrip() == "--" or _is_disclaimer(kept[at:])):
            break
        kept = kept[:at].rstrip()
    return kept if kept.strip() else s


def _writing(paragraph: str) -> str:
    """Which letters a paragraph of sentences is written in, empty for dumps, links and tables."""
    letters = [c for c in paragraph if c.isalpha()]
    if "\t" in paragraph or "://" in paragraph or len(letters) < 0.7 * len("".join(paragraph.split())):
        return ""
    return "cyrillic" if sum("\u0400" <= c <= "\u052f" for c in letters) > 0.5 * len(letters) else "other"


def _after_original(s: str, m: re.Match) -> str:
    """The part around a forwarded original: what is above it; if nothing is, what follows it from its second greeting or last wide gap on."""
    if s[: m.start()].strip():
        return s[: m.start()]
    rest = s[m.end() :]
    _, _, rest = rest.partition("\n\n")
    # the writer's own closing and signature are no bounds of the original
    rest = _without_end(rest)
    starts = [x.start() for x in re.finditer(r"(?:\A|(?<=\n\n))[^\n]{2,60}(?=\n[ \t]*\n)", rest) if _is_greeting(x[0])]
    starts = [x for x in starts if rest[:x].strip()]
    gap = rest.rfind("\n\n\n")
    if starts:
        return rest[starts[-1] :]
    if gap >= 0 and rest[gap:].strip():
        return rest[gap:]
    # otherwise what comes after the original's closing or signature
    paragraphs = [p for p in _BLANK.split(rest) if p.strip()]
    ends = [i for i, p in enumerate(paragraphs[:-1]) if p.strip().lower().startswith(CLOSINGS) or p.lstrip("\n").startswith("-- \n")]
    if ends:
        return "\n\n".join(paragraphs[ends[0] + 1 :])
    # or after its last paragraph in another script, or the dump or table that it is; or else all but its first paragraph, since no more is known to be its own
    written = [(i, w) for i, p in enumerate(paragraphs) if (w := _writing(p))]
    turns = [i for (_, v), (i, w) in zip(written, written[1:], strict=False) if v != w]
    if turns:
        start = turns[-1]
    elif written and written[0][0]:
        start = written[0][0]
    else:
        start = min(1 + _is_greeting(paragraphs[0]), len(paragraphs) - 1) if paragraphs else 0
    return "\n\n".join(paragraphs[start:])


def own_part(text: str | None) -> str:
    """What the writer of a raw mail wrote themselves."""
    if not text or text.isspace():
        return ""
    s = readable(text)
    if "--" in s and (m := _ORIGINAL.search(s)):
        s = _after_original(s, m)
    if ">" in s or "\n|" in s:
        s = _unquoted(s)
    if "\n-- " in s or "\n--\n" in s or s.startswith("-- \n"):
        s = s[: _SIGNATURE.search(s + "\n").start()] if _SIGNATURE.search(s + "\n") else s
    if m := _RULE.search(s):
        s = s[: m.start()]
    paragraphs = [p for p in re.split(r"\n[ \t]*\n", s) if p.strip()]
    while paragraphs and _is_disclaimer(paragraphs[-1]):
        paragraphs.pop()
    for i in range(max(0, len(paragraphs) - 2), len(paragraphs)):
        lines = paragraphs[i].strip("\n").split("\n")
        for j in range(max(0, len(lines) - 4), len(lines)):
            if len(lines[j]) < 40 and lines[j].strip().lower().startswith(CLOSINGS):
                paragraphs[i:] = ["\n".join(lines[:j])] if j else []
                break
        else:
            continue
        break
    if paragraphs:
        first, _, rest = paragraphs[0].strip("\n").partition("\n")
        if not rest and _is_greeting(first):
            paragraphs.pop(0)
    return "\n\n".join(p.strip("\n") for p in paragraphs)
