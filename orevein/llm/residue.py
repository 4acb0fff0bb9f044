"""Template residue and error-page text (problem 10).

Normalised lines are counted by source and the recurrent ones (the site's furniture, cookie notices among it) taken out, as in
``sitelines``. What is left of a document is read line by line and sentence by sentence for evidence of four kinds: unfilled slots and
marks of values never set, filler or stub text, error messages, and demands for scripts, cookies or a browser check. An error
or a demand counts where a line consists of it; a slot counts in a sentence of its own or of the text, unless the line is
code or the sentence speaks about slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .sitelines import residual_lines

_NAME = r"[A-Za-z_][\w.\- ]{0,40}?"
#: Unfilled slots of common template languages.
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\{{%\s*{_NAME}\s*%\}}|%%\s*{_NAME}\s*%%|@@\s*{_NAME}\s*@@"
    rf"|\[\[\s*{_NAME}\s*\]\]|__[A-Z][A-Z0-9_.]*?__|\[(?:INSERT|YOUR|ENTER|ADD)\s+[A-Z][A-Z _.]*\]|(?<![\w$#{{])\{{[A-Za-z_][\w.]*\}}(?![\w}}])|(?<!\w)%[A-Za-z_]+%(?!\w)|\[(?:NAME|TITLE|DATE|CITY|AUTHOR|COMPANY)\]"
)
#: Words of sentences that speak about slots.
ABOUT = re.compile(r"\b(?:templates?|placeholders?|syntax|variables?|writing|prints?|printed|sign|replaced|substitut\w+|vorlage|platzhalter|modèle|plantilla|modelo|шаблон\w*)\b", re.I)
#: Lines of code: a call, an assignment, a tag around the slot, shell or query words.
CODE = re.compile(r"""^\s*(?:[\w.]+\s*\(|[\w.]+\s*=\s|<\w+[^>]*>.*</\w+>|echo\b|print\b|import\b|from\s+\w+\s+import|def\b|for\s*\(|if\s*\(|SELECT\b|\$\s|\{"|#include|return\b|var\b|let\b|const\b)|;\s*$""")
_UNSET = r"(?:NaN|null|undefined|None|\[object Object\])"
#: Marks of values never set, where a value should stand.
UNSET = re.compile(rf"^(?:welcome|hello|hi|dear|bienvenid[oa]|bienvenue|willkommen|bem-vindo)\W+{_UNSET}(?!\w)|^[\w ]{{1,30}}:\s*(?:[€$£]\s*)?{_UNSET}\s*(?:[€$£]|EUR|USD)?\W*$|\b(?:have|has)\s+{_UNSET}\s+new\b|^{_UNSET}(?:\W+{_UNSET})*$|[€$£]\s*{_UNSET}(?!\w)|\[object Object\]")
#: Filler and stub text, by its openings.
FILLER = re.compile(
    r"""^(?:(?:heading|body\s+copy|title|text|content|your\s+\w+|caption|subtitle|headline|description|image)\s+(?:goes\s+)?here\b
    |your\s+(?:text|content|title)\s+(?:goes\s+)?here|(?:sample|dummy|placeholder|example)\s+text\b|lorem\s+ipsum|ipsum\s+lorem
    |replace\s+this\s+(?:text|paragraph|content)|this\s+is\s+an?\s+(?:example|sample|placeholder|default)\s+(?:page|post|paragraph|text)
    |(?:todo|tbd|fixme|xxx)\b\s*:?|(?:content|text|description)\s+(?:to\s+follow|coming\s+soon|to\s+be\s+added|tbd)|coming\s+soon\b|under\s+construction
    |(?:page|site|this\s+page|this\s+site)\s+(?:is\s+)?under\s+construction|add\s+(?:your\s+)?(?:text|content|description)\s+here|insert\s+(?:your\s+)?(?:text|content|title|description)\b
    |testo\s+(?:di\s+(?:esempio|prova)|segnaposto)|inserire\s+(?:qui\s+)?(?:il\s+)?testo|(?:sito|pagina)\s+in\s+costruzione|voorbeeldtekst\b|(?:hier\s+)?komt\s+(?:uw|de)\s+tekst|tekst\s+(?:zastępczy|przykładowy)|strona\s+w\s+budowie
    |text\s+folgt\b|inhalt\s+folgt\b|hier\s+(?:steht|kommt|folgt|entsteht)\b.{0,40}\b(?:text|inhalt|blindtext|website|seite)|(?:das\s+ist\s+ein\s+)?(?:blindtext|platzhalter(?:text)?|beispieltext|mustertext)\b
    |ins[ée]rer\s+(?:le|votre|un)\s+texte|(?:texte|contenu)\s+(?:à\s+venir|d['’]exemple|de\s+remplissage|ici)|page\s+en\s+construction
    |(?:inserte|insertar|escriba|añada|ponga)\s+(?:el|su|aquí|un)\b.{0,25}\b(?:texto|contenido|aquí)|texto\s+(?:de\s+(?:ejemplo|relleno|muestra|exemplo|preenchimento)|aquí|aqui|pendiente)|(?:página|sitio)\s+en\s+construcción|próximamente
    |(?:insira|inserir|escreva|coloque)\s+(?:o|seu|aqui|um)\b.{0,25}\b(?:texto|conteúdo|aqui)|página\s+em\s+construção|em\s+breve
    |(?:вставьте|введите|добавьте)\s.{0,20}текст|(?:здесь|тут)\s+(?:будет|должен)\b.{0,20}текст|текст\s+(?:появится|скоро|будет)|страница\s+в\s+разработке|пример\s+текста
    |(?:asdf|qwer|qwerty|hjkl|foo\s+bar|test\s+test|blah\s+blah|xxx+)\b)""",
    re.I | re.X,
)
_STATUS = r"(?:4\d\d|5\d\d)"
#: Error, crash and maintenance messages, by their openings.
ERROR = re.compile(
    rf"""^(?:(?:error|http|erreur|fehler|status|erro|ошибка)?\s*:?\s*{_STATUS}\b\s*[:\-–—]?\s*(?:error\b|erreur\b|fehler\b|ошибка\b)?\s*(?:(?:internal|bad|gateway|service|not|page|forbidden|unauthori[sz]ed|too|request|moved|gone|server|method|access|proxy|the|we|oops|seite|página|страница|temporarily|file)\b|$)
    |error\s+{_STATUS}\b|(?:page|file|site|resource|url|article|document|content)\s+not\s+found\b|not\s+found\W*$|seite\s+nicht\s+gefunden|page\s+(?:introuvable|non\s+trouvée)|página\s+no\s+encontrada|p[áa]gina\s+n[ãa]o\s+encontrada|страница\s+не\s+найдена
    |pagina\s+non\s+trovata|pagina\s+niet\s+gevonden|nie\s+znaleziono\s+strony|strona\s+nie\s+(?:została\s+znaleziona|istnieje)|la\s+pagina\s+(?:richiesta|cercata)|de\s+(?:opgevraagde|gevraagde)\s+pagina|errore\s+{_STATUS}|fout\s+{_STATUS}|błąd\s+{_STATUS}
    |(?:la\s+)?page\s+(?:demandée|que\s+vous)|die\s+(?:angeforderte|gesuchte)\s+seite|la\s+página\s+(?:solicitada|que)\b|a\s+página\s+(?:solicitada|que\s+você)
    |we\s+can(?:['’]|no)t\s+find|the\s+(?:requested\s+)?(?:address|page|url|file|resource|document)\s.{{0,30}}(?:not\s+found|does\s+not\s+exist|no\s+longer|could\s+not)|this\s+page\s+(?:does\s+not\s+exist|isn['’]t\s+available|could\s+not)
    |oops\b|sorry,?\s.{{0,40}}(?:not\s+found|went\s+wrong|doesn['’]t\s+exist|unavailable)|something\s+went\s+wrong|an?\s+(?:unexpected|unknown|internal|fatal)?\s*error\s+(?:has\s+)?occur
    |(?:uncaught|unhandled)\b.{{0,30}}\b(?:exception|error)|(?:fatal|parse|syntax|internal\s+server|database|runtime|connection|server|application|type|reference)\s*error\b\s*(?:[:!.\-–(]|$)|error\s+(?:establishing|connecting|loading|code)\b|\w+(?:Error|Exception)\b\s*(?::|at\b|in\b)|traceback\s*\(most|warning:\s+\w+\(|notice:\s+undefined|segmentation\s+fault|stack\s+trace\b|call\s+stack\b
    |(?:database|server|host|upstream|network)?\s*connection\s+(?:has\s+|was\s+)?(?:failed|refused|lost|reset|timed\s+out|closed)\b|(?:could\s+not|cannot|can['’]t|unable\s+to|failed\s+to)\s+(?:connect|load|open|find|resolve)\b
    |(?:access|permission)\s+(?:is\s+)?denied\b|(?:forbidden|unauthorized|bad\s+gateway|bad\s+request|gateway\s+time-?out|internal\s+server\s+error|service\s+(?:temporarily\s+)?unavailable|request\s+time-?out|too\s+many\s+requests)\b\s*(?:$|[.!:\-–—/(])
    |accesso\s+negato|toegang\s+geweigerd|odmowa\s+dostępu|(?:il\s+)?sito\s+(?:è\s+)?in\s+manutenzione|(?:de\s+)?(?:site|website)\s+is\s+in\s+onderhoud|zugriff\s+verweigert|accès\s+(?:refusé|interdit)|acceso\s+denegado|acesso\s+negado|доступ\s+запрещ
    |(?:the|this|our)\s+(?:site|website|page|server|service|system)\s+is\s+(?:currently\s+|temporarily\s+)?(?:down|undergoing|under\s+maintenance|offline|unavailable|being)|(?:site|website|scheduled|we\s+are|we['’]re)\s.{{0,25}}maintenance\b|down\s+for\s+maintenance|(?:wegen\s+)?wartungsarbeiten|(?:site\s+)?en\s+maintenance|(?:sitio\s+)?en\s+mantenimiento|(?:site\s+)?em\s+manutenção|технические\s+работы
    |we['’]?(?:\s+wi|['’]?)ll\s+be\s+(?:right\s+)?back)""",
    re.I | re.X,
)
#: Demands for scripts, cookies or a browser check, by their openings.
DEMAND = re.compile(
    r"""^(?:(?:please\s+|you\s+(?:need|have)\s+to\s+|you\s+must\s+)?(?:enable|turn\s+on|activate|allow|switch\s+on)\s+(?:javascript|scripts?|cookies|js)\b|(?:javascript|scripts?|cookies|js)\s+(?:and\s+\w+\s+)?(?:is|are|must|has|have|needs?)\s+(?:be\s+|to\s+be\s+)?(?:required|disabled|enabled|blocked|turned|needed|off|necessary)
    |(?:this|our|the)\s+(?:site|page|app|website|application|service)\s+(?:requires?|needs?)\s.{0,30}\b(?:javascript|scripts?|cookies)|(?:this\s+(?:site|page|app)\s+)?(?:requires?)\s+(?:javascript|cookies)|your\s+browser\s+(?:is\s+(?:not\s+supported|out\s+of\s+date|outdated|too\s+old)|does\s+not|doesn['’]t|has\s+(?:javascript|cookies))
    |checking\s+(?:your\s+browser|if\s+the\s+site|that\s+you)|(?:verifying|verify|please\s+confirm|confirm)\s+(?:that\s+)?you\s+are\s+(?:a\s+)?(?:human|not\s+a\s+robot)|just\s+a\s+moment|one\s+moment\W|ddos\s+protection|you\s+need\s+to\s.{0,20}javascript
    |(?:veuillez\s+)?(?:activer|activez|autoriser)\s+(?:le\s+|les\s+)?(?:javascript|scripts?|cookies)|veuillez\s+.{0,15}\b(?:javascript|cookies)|(?:active|activa|activar|habilite|habilita|permita)\s+(?:el\s+|las\s+|o\s+|os\s+)?(?:javascript|cookies|scripts?)|(?:por\s+favor,?\s+)(?:active|habilite|ative)\b
    |(?:si\s+prega\s+di\s+)?(?:abilitare|attivare|abilita|attiva)\s+(?:i\s+|gli\s+)?(?:javascript|cookie|script)|(?:javascript|cookies?)\s+(?:deve|devono|è|sono|moet|moeten|musi|muszą)\b|(?:schakel|zet)\s+(?:javascript|cookies)\b|(?:proszę\s+)?(?:włącz|włączyć)\s+(?:obsługę\s+)?(?:javascript|cookies|ciastecz\w+)
    |(?:ative|ativar|habilitar)\s+(?:o\s+|os\s+)?(?:javascript|cookies)|(?:bitte\s+)(?:aktivieren|erlauben|schalten)\s.{0,15}(?:javascript|cookies|skripte)|(?:javascript|cookies)\s+(?:aktivieren|muss|müssen|ist|sind|requis|doit|debe|deve)\b|(?:включите|разрешите)\s+(?:javascript|cookie|скрипт))""",
    re.I | re.X,
)
# The words that filler texts in mock Latin open with or repeat.
MOCK_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor incididunt labore dolore magna aliqua vitae nulla morbi pellentesque sodales tincidunt orci unda".split())
_LATIN_SIGNS = ("lorem", "ipsum", "dolor")
_SLOT_SIGNS = re.compile(r"[{\[%@]|__")
_UNSET_SIGNS = ("NaN", "null", "undefined", "None", "[object")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: A sentence longer than this is a message only if its opening names what it is about: a status, scripts or cookies, and it speaks to the reader; or the
#: text that is to stand here.
SHORT_WORDS = 14
_NAMED = re.compile(rf"\b{_STATUS}\b|script|cookie|\bjs\b|скрипт", re.I)
_STANDS_FOR_TEXT = re.compile(r"\b(?:text\w*|tekst\w*|testo|texto|texte|текст\w*|content|contenu|contenido|conteúdo|inhalt|copy|ipsum|placeholder|platzhalter\w*|blindtext|paragraph)\b", re.I)
_TO_READER = re.compile(r"\b(?:please|you|your|bitte|sie|ihr\w*|veuillez|vous|votre|vos|por\s+favor|si\s+prega|tuo|vostro|uw|proszę|usted|su|você|seu|пожалуйста|вы|ваш\w*|вам)\b", re.I)


def _long_message(opening: re.Match | None, sentence: str) -> bool:
    return opening is not None and _NAMED.search(opening[0]) is not None and _TO_READER.search(sentence) is not None and not ABOUT.search(sentence)


def _mock_latin(words: list[str]) -> bool:
    """Many words, few different ones, an eighth of them mock Latin and both lorem and ipsum among them or a fifth without."""
    if len(words) < 8:
        return False
    known = [w for w in words if w in MOCK_LATIN]
    return len(known) * 8 >= len(words) and len({*known}) >= 3


def evidence(lines: list[str]) -> str | None:
    """The kind of evidence in a text's residual lines: slot, unset, filler, error, demand; null if there is none."""
    for line in lines:
        # plain substrings rule most lines out before a pattern is tried
        slots = _SLOT_SIGNS.search(line) is not None
        unset = any(x in line for x in _UNSET_SIGNS)
        for sentence in _SENTENCE.split(line):
            if slots and SLOT.search(sentence) and not CODE.search(line) and not ABOUT.search(sentence):
                return "slot"
            if unset and UNSET.search(sentence):
                return "unset"
            if sentence.count(" ") < SHORT_WORDS:
                if FILLER.match(sentence):
                    return "filler"
                if ERROR.match(sentence) and not CODE.search(line):
                    return "error"
                if DEMAND.match(sentence):
                    return "demand"
            elif (opening := FILLER.match(sentence)) and _STANDS_FOR_TEXT.search(opening[0]) and not ABOUT.search(sentence[opening.end() :]):
                return "filler"
            elif _long_message(ERROR.match(sentence), sentence) and not CODE.search(line):
                return "error"
            elif _long_message(DEMAND.match(sentence), sentence):
                return "demand"
        low = line.lower()
        if any(x in low for x in _LATIN_SIGNS) and _mock_latin(_WORD.findall(low)):
            return "filler"
    return None


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        kinds = [evidence(list(x)) if x is not None else None for x in frame["lines"]]
        out = pd.DataFrame({"doc_id": frame["doc_id"], "kind": kinds})
        yield out[out["kind"].notna()]


def residue(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind)`` of the documents with residue in place of content.

    Nulls, empty texts and texts of furniture only have none; documents without an id are left out; repeated rows are reported as often; texts of any length are read whole.
    A document without a source has no furniture to take out.
    """
    return residual_lines(documents).drop("keys").where("doc_id is not null").mapInPandas(_batches, "doc_id long, kind string")
