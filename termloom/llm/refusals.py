"""Whether a reply declines: its clauses are aligned with templates of slots.

A template is a row of slots; a slot is a set of words, or of word beginnings where it ends in *. A clause fits a template
if words of its slots stand in it in order, at most GAP others between two of them, and no word before them opens a
question or a dependent clause ("why i cannot ..."). Clauses are aligned one by one, never across their borders.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[,;:\n()\"“”«»]+|[.!?。]+(?=\s|$)|\s[—–-]+\s")
GAP = 4
#: A list is a refusal only if at least this share of its members decline.
DECLINING_SHARE = 0.5
#: Sentences have more words between their commas than listed terms do.
SENTENCE_WORDS, TERM_WORDS = 2.5, 4

#: Slots by name, how declining is put in four languages. ^ is the clause's start.
SLOTS = {
    "I": "i|we",
    "NEG": "cannot|not|t|unable|never|cant|wont|dont",
    "ACT": "help*|assist*|answer*|respon*|reply*|provid*|giv*|offer*|comply*|fulfil*|complet*|process*|handl*|support*|discuss*|shar*|disclos*|reveal*|say|tell|comment*|advis*|suggest*|recommend*|generat*|produc*|engag*|proceed*|continu*|address*|accommodat*|speak*|assess*|choos*|decid*",
    "OBJ": "information|knowledge|access|data|context|answer*|response|details|ability|capability|idea|permission|enough|sufficient|expertise",
    "MINE": "my|our|content|what",
    "ASKED": "this|that|it|question*|request*|query|queries|topic|subject|prompt",
    "DONE": "answered|processed|fulfilled|completed|handled|discussed|addressed|supported|provided|given|possible|allowed|permitted|appropriate|available|accommodated",
    "ICH": "ich|wir|mir|uns",
    "KANN": "kann|können|könnte|könnten|darf|dürfen|möchte|möchten|will|wollen|werde|werden|vermag|mag",
    "NICHT": "nicht|nichts|kein|keine|keinen|keinerlei|keiner|niemals",
    "TUN": "helf*|weiterhelf*|behilflich|beantwort*|antwort*|sagen|geben|nennen|erteilen|bearbeit*|erfüll*|unterstütz*|äußern|liefern|anbieten|dienen|mitteil*|bereitstell*|vorschlag*|erstell*|beurteil*|entsprech*|nachkomm*|auskunft|weitergeben",
    "WISSEN": "information*|daten|kenntnis*|zugriff|zugang|angaben|auskunft|wissen|antwort*|berechtigung",
    "JE": "je|j|nous",
    "NE": "ne|n",
    "POUVOIR": "peux|peut|pouvons|puis|pourr*|saur*|veux|voulons|souhait*|vais|dois",
    "FAIRE": "aid*|répon*|fourni*|donn*|trait*|dire|parler|discut*|renseign*|propos*|satisfai*|accéd*|assist*|communiqu*|partag*|indiqu*|exécut*|génér*|suite|conseill*|comment*|faire",
    "SAVOIR": "information*|accès|donnée*|connaissance*|réponse*|contexte|élément*|droit|autorisation",
    "PUEDO": "puedo|podemos|podr*|debo|debemos|quiero|deseo|voy|vamos",
    "HACER": "ayud*|respond*|contest*|dar|darte|darle|darles|proporcion*|facilit*|proces*|atend*|decir*|ofrec*|hablar|coment*|cumpl*|complet*|gener*|asist*|brind*|compart*|revel*|opin*|nombr*|hacer*|realiz*|suger*",
    "SABER": "información|informacion|acceso|datos|conocimiento*|respuesta*|contexto|permiso|suficiente*|autorización",
}
TEMPLATES = """
I NEG ACT
I NEG do|fulfill this|that|so|it
I NEG know|understand|recall|comfortable|allowed|permitted|authori*|qualified|equipped|able|find
I NEG have|possess|has OBJ
I have|possess no|insufficient OBJ
I lack*
I declin*|refus*|abstain*|refrain*|apologi*|regret*
I rather|prefer not
^ unable|cannot|not|cant|wont ACT
^ can|won|could|don|will t ACT
beyond|outside|against|violat*|exceed*|contraven*|breach* MINE
ASKED cannot|not|t|never DONE
no answer*|response*|terms|information|words|result* is|are|can|could|be|was
not|t|no enough|sufficient context|information|data|details|knowledge
insufficient context|information|data|details|knowledge
as an|a ai|assistant|chatbot|artificial|language
inappropriate|improper|unethical|wrong|appropriate|possible for me|us
not something i|we
my|our guidelines|instructions|programming|policy|policies|rules|training|principles prevent*|forbid*|prohibit*|not|t|restrict*|disallow*
request|question|query denied|declined|refused|rejected|blocked
KANN ICH NICHT TUN
ICH KANN NICHT TUN
KANN NICHT TUN ICH
^ kann|können NICHT TUN
ICH weiß|weiss|wissen|verstehe|verstehen|kenne|kennen NICHT
weiß|weiss|verstehe|kenne ich|wir NICHT
ICH ablehnen|verweigern|verweigere|weigere|weigern|lehne|passen
als ki|sprachmodell|assistent*|künstliche|modell
ICH nicht lage
mir|uns|ist nicht möglich|gestattet|erlaubt
mir|uns unmöglich|untersagt|verboten
ICH NICHT WISSEN
NICHT WISSEN ICH
außerhalb|gegen|jenseits|übersteig*|widersprich* mein*|unser*
lieber|eher nicht TUN
NICHT antwort*|auskunft geben|erteilen|möglich|verfügbar|gegeben
JE NE POUVOIR FAIRE
JE NE sais|savons|comprends|comprenons|connais|trouve pas|rien
JE NE suis|sommes mesure|autoris*|capable*|habilit*|sûr*
JE NE dispose*|ai|avons|possède* SAVOIR
JE refuse|refusons|décline|déclinons|regrette|regrettons
JE dois|préfér*|aimerais|devons|voudrais déclin*|refus*|pas|abstenir
impossible FAIRE
m|nous est impossible|interdit
n|ne pas possible FAIRE
en tant ia|modèle|assistant*|intelligence
dépass*|hors|delà|contraire*|contrevient|enfreint mes|ma|mon|nos|notre
aucun|aucune réponse*|information*|terme*|résultat* peut|donnée*|possible|disponible*|être
question|demande|requête ne|n pas|être|peut traitée|satisfaite|aboutir|acceptée
no PUEDO HACER
no sé|sabemos|entiendo|entendemos|comprendo|conozco|conocemos
no tengo|tenemos|dispongo|disponemos|poseo|cuento|contamos SABER|esa|ese|esos|esas
no estoy|estamos|soy|somos condiciones|autoriz*|capaz|capac*|seguro|facult*|habilit*
no me|nos es|está|resulta posible|permitid*|autoriz*
no es|resulta posible HACER
me|nos es|resulta imposible
imposible HACER
prefiero|preferimos|preferir* no
tengo|tenemos|debo|debemos|veo|vemos negar*|rechaz*|declin*|absten*
me|nos niego|negamos|abstengo
^ rechazo|declino
como ia|modelo|asistente|inteligencia
fuera|contra|excede*|supera*|sobrepasa* mi|mis|nuestr*
no hay|existe respuesta*|información|términos|datos|resultado* disponible*|posible*|para
"""
#: Words of a sentence that denies, or speaks of the speaker or of the exchange, which no listed term does.
SPOKEN = """
i me my mine myself we us our cannot not no nothing none never nor t unable unfortunately regrettably sorry afraid apolog* question* request* answer* respon* assistant
ich mir mich mein* wir uns unser* nicht nichts kein* nie niemals leider bedauer* entschuldig* verzeih* frage anfrage antwort* beantwort* assistent*
je j me m moi mes mon ma nous notre nos ne n pas rien aucun* jamais désol* navré* malheureusement question demande requête répon*
yo me mi mis nosotros nuestr* no ni nada ningun* tampoco siento lamento perdón disculp* pregunta solicitud petición consulta respuesta* respond* asistente
"""
#: Words that open a question or a dependent clause.
OPENERS = frozenset("how why what when where who which whose if whether because wie warum was wann wo wer ob weil wenn comment pourquoi quand où qui quel quelle si parce cómo cuándo dónde quién cuál porque cuando donde".split())


def _slot(text: str) -> re.Pattern:
    names = SLOTS.get(text, text).split("|")
    names = [n for name in names for n in SLOTS.get(name, name).split("|")]
    return re.compile("|".join(re.escape(n[:-1]) + ".*" if n.endswith("*") else re.escape(n) for n in names))


def _read(text: str) -> list[tuple[bool, list[re.Pattern]]]:
    out = []
    for line in text.strip().split("\n"):
        slots = line.split()
        anchored = slots[0] == "^"
        out.append((anchored, [_slot(s) for s in slots[anchored:]]))
    return out


_templates, _spoken = _read(TEMPLATES), _slot("|".join(SPOKEN.split()))


def aligned(slots: list[re.Pattern], words: list[str], anchored: bool = False) -> bool:
    """Whether the slots stand in words in order, with gaps of at most GAP words and no opener before the first."""
    ends = set()
    for i, w in enumerate(words):
        if w in OPENERS or anchored and i:
            break
        if slots[0].fullmatch(w):
            ends.add(i)
    for slot in slots[1:]:
        ends = {j for i in ends for j in range(i + 1, min(len(words), i + 2 + GAP)) if slot.fullmatch(words[j])}
    return bool(ends)


def clauses_of(text: str) -> list[list[str]]:
    return [w for w in ([x.lower() for x in WORD.findall(part)] for part in CLAUSE.split(text)) if w]


def declines(clause: list[str]) -> bool:
    return len(clause) > 1 and any(aligned(slots, clause, anchored) for anchored, slots in _templates)


def is_sentence(clauses: list[list[str]]) -> bool:
    return bool(clauses) and sum(map(len, clauses)) >= SENTENCE_WORDS * len(clauses)


def is_listing(clauses: list[list[str]]) -> bool:
    """Several short clauses: listed terms, whatever the words before them say."""
    return len(clauses) > 2 and sorted(map(len, clauses))[len(clauses) // 2] <= TERM_WORDS


def is_spoken(clauses: list[list[str]]) -> bool:
    """No list, and more than single words."""
    return not is_listing(clauses) and any(len(c) > 1 for c in clauses)


def is_refusal(terms: list[str], sentences: bool, question: Sequence[str] = ()) -> bool:
    """Whether a reply declines. terms are a list's members, or the parts of a reply in sentences.

    Of a list, half the members have to fit a template; a lone member that ends like a sentence is one. Of sentences one
    clause has to, if they are no terms between commas. A reply in sentences that lists nothing also declines where it
    denies, or speaks of itself or of the question, in words that the question lacks.
    """
    lone = len(terms) == 1 and not sentences and terms[0].rstrip().endswith((".", "!"))
    clauses = [c for t in terms for c in clauses_of(t)]
    if not sentences and not lone:
        told = sum(any(map(declines, clauses_of(t))) for t in terms)
        return told > 0 and told >= DECLINING_SHARE * len(terms)
    if is_sentence(clauses) and any(map(declines, clauses)):
        return True
    said = {w for c in clauses for w in c} - set(question)
    return is_spoken(clauses) and any(map(_spoken.fullmatch, said))
