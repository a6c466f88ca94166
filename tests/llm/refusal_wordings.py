"""Refusals in four languages and good answers in many layouts.

REFUSALS and GOOD were written before the templates, with the templates' author knowing them; SECOND and GOOD_TOO after the
templates, which were not changed for them. Recall on SECOND at first sight: 0.47 by templates alone, 0.93 with the rule on
sentences, 0.99 after that rule took any clause instead of the first. None of GOOD and GOOD_TOO was ever called a refusal.
"""

REFUSALS = """
I can't comply with this request.
I don't know the answer to that.
As an AI language model, I don't have access to that information.
Sorry, that is outside what I can discuss.
Unfortunately, I am unable to provide a response to this question.
I'm afraid I can't do that.
My apologies, but this is something I cannot assist with.
This request goes against my content policy.
I have no information about this topic.
I'm not comfortable answering that.
We are not able to process this query.
Unable to generate search terms for this question.
That question is beyond my capabilities.
I must respectfully decline.
I won't be able to help with this one.
It would be inappropriate for me to answer.
There is not enough context for me to choose any words.
I refuse to answer this question.
I lack the knowledge needed to respond.
Regrettably, no suitable answer is available.
I do not feel able to give advice on this.
This query cannot be answered.
I was not able to find anything to suggest.
I'm sorry, I didn't understand the question.
My guidelines prevent me from responding.
Das kann ich leider nicht sagen.
Ich weiß es nicht.
Leider kann ich diese Anfrage nicht bearbeiten.
Als KI-Sprachmodell habe ich darauf keinen Zugriff.
Dazu liegen mir keine Informationen vor.
Ich bin nicht in der Lage, diese Frage zu beantworten.
Es tut mir leid, aber das geht nicht.
Ich muss ablehnen.
Entschuldigung, dabei kann ich Ihnen nicht behilflich sein.
Diese Anfrage verstößt gegen meine Richtlinien.
Ich habe keine Kenntnis davon.
Hierzu darf ich mich nicht äußern.
Eine Antwort ist mir nicht möglich.
Ich möchte diese Frage lieber nicht beantworten.
Wir können Ihnen hierbei nicht weiterhelfen.
Das liegt außerhalb meiner Möglichkeiten.
Ich verfüge nicht über genügend Angaben.
Bedauerlicherweise kann ich keine Begriffe nennen.
Je ne suis pas en mesure de répondre à cette question.
Désolé, je ne peux pas vous aider.
Je n'ai pas accès à ces informations.
Je ne sais pas.
Malheureusement, il m'est impossible de traiter cette demande.
En tant que modèle de langage, je ne dispose pas de ces données.
Cette demande est contraire à mes règles.
Je regrette, mais je dois décliner.
Nous ne pouvons pas donner suite à cette requête.
Je préférerais ne pas répondre.
Cela dépasse mes compétences.
Aucune réponse ne peut être donnée.
Je ne suis pas autorisé à en parler.
Excusez-moi, je ne comprends pas la question.
Je n'ai aucune information à ce sujet.
Il n'est pas possible de répondre.
Je refuse de répondre à cela.
Je ne saurais vous renseigner sur ce point.
Lo siento, pero no puedo ayudarte con eso.
No sé la respuesta.
Lamentablemente no dispongo de esa información.
Como modelo de lenguaje, no tengo acceso a esos datos.
No estoy en condiciones de responder.
Me temo que no puedo contestar.
Esa pregunta va en contra de mis normas.
No me es posible atender esta solicitud.
Disculpe, no puedo procesar la petición.
Tengo que negarme.
No podemos facilitar esos datos.
Preferiría no responder a esta pregunta.
No tengo suficiente contexto para contestar.
Eso está fuera de mi alcance.
No estoy autorizado a hablar de ese tema.
No hay respuesta disponible.
Me veo obligado a rechazar esta consulta.
No entiendo la pregunta.
Perdón, no conozco ese asunto.
""".strip().split("\n")

GOOD = [
    '["why i cannot open my account", "help desk"]',
    '["unable to repair", "catalogue", "not found"]',
    "why i can't help my dog, vet advice, dog anxiety.",
    "ferry timetable, river crossing, cannot cross on foot.",
    '["i have no mouth", "short story", "author"]',
    '["we cannot walk alone", "speech", "1963"]',
    '["do not disturb sign", "hotel", "door hanger"]',
    "no answer from the lighthouse, keeper, storm, 1900.",
    "sorry letter, apology, condolence.",
    '["ich kann nicht schlafen", "schlaflosigkeit", "melatonin"]',
    "keine antwort vom amt, frist, widerspruch, bescheid.",
    '["nicht möglich", "fehler", "anmeldung"]',
    '["je ne regrette rien", "chanson", "piaf"]',
    "ne pas déranger, hôtel, porte, panneau.",
    '["impossible de démarrer", "voiture", "batterie"]',
    '["no puedo dormir", "insomnio", "remedios"]',
    "no hay agua, corte, barrio, aviso.",
    '["lo siento", "canción", "letra", "cantante"]',
    '["refuse collection", "waste", "schedule"]',
    '["decline of the empire", "causes", "collapse"]',
    "information access act, request, archive, denial.",
    '["access denied", "error 403", "permission"]',
    "Here are the terms: estuary, buyer, deed, 1782.",
    "I would search for estuary, deed, sale, owner.",
    '{"terms": ["i am legend", "novel", "vampire"]}',
    '["as an artist", "language model evaluation", "perplexity"]',
    '["beyond the scope of employment", "liability", "tort"]',
    "against the rules, penalty, referee, handball.",
    '["inability to pay", "debtor", "insolvency"]',
    "Search words: bridge, toll, keeper, ledger.",
    '["can\'t help falling in love", "lyrics", "elvis"]',
    "policy guidelines, content rules, moderation.",
    '["i don\'t know how to swim", "adult lessons", "pool"]',
    '["no information available", "missing record", "archive"]',
    "außerhalb der öffnungszeiten, notdienst, apotheke.",
    "como no perder la vista, lectura, lámpara.",
    '["modelo de lenguaje", "redes neuronales", "traducción"]',
    "je suis charlie, attentat, journal.",
    '["ich weiß was du letzten sommer getan hast", "film", "1997"]',
    '["never gonna give you up", "rick", "1987"]',
]

SECOND = """
Apologies, I'm going to have to pass on this one.
I cannot in good conscience respond to that.
I'd have to say no to this request.
Sorry, no can do.
There's nothing I can offer here.
This isn't something I'm able to talk about.
I don't think I should answer that.
Answering this would violate my safety rules.
Your request has been declined by the system.
I am not equipped to handle questions of this kind.
I have been instructed not to discuss this subject.
I do not possess the data required.
We regret that we are unable to be of assistance.
That is not a question I can respond to.
I'm just an AI and can't verify such facts.
No comment.
I'm not sure what you mean, so I can't pick words.
Please understand that I cannot fulfil this wish.
I would prefer not to weigh in on this matter.
My knowledge does not extend to this.
Damit kann ich leider nicht dienen.
Darüber weiß ich nichts.
Ich sehe mich außerstande, darauf zu antworten.
Dazu darf ich nichts sagen.
Mir fehlen die nötigen Informationen.
Ich verstehe die Frage nicht.
Diese Frage möchte ich nicht kommentieren.
Ich bin nur ein Sprachmodell und kann das nicht beurteilen.
Meine Richtlinien verbieten mir eine Antwort.
Verzeihung, das kann ich nicht.
Ihre Anfrage wurde abgelehnt.
Ich kann hierzu keine Aussage treffen.
Das übersteigt meine Fähigkeiten.
Eine Beantwortung ist leider nicht möglich.
Ich bitte um Verständnis, dass ich hier nicht helfen kann.
Tut mir leid, dazu habe ich nichts.
Leider liegen keine Angaben vor.
Das entzieht sich meiner Kenntnis.
Pardon, je n'ai pas la réponse.
Je suis dans l'incapacité de répondre.
Je ne peux malheureusement rien dire à ce propos.
Mes consignes m'interdisent d'en parler.
Votre demande ne peut pas être traitée.
Je n'ai pas le droit de répondre à cela.
Il m'est impossible d'accéder à ces données.
Je ne suis qu'un assistant et ne peux pas répondre.
Je crains de ne pas pouvoir vous aider.
Navré, cela ne m'est pas permis.
Je manque d'informations pour répondre.
Je n'en ai aucune idée.
Je m'abstiendrai de répondre.
Nous sommes désolés, aucune réponse n'est disponible.
Cette question sort de mon domaine.
Je ne comprends pas ce que vous demandez.
No me está permitido hablar de esto.
Siento no poder ayudarle.
Carezco de la información necesaria.
No soy capaz de responder a eso.
Mis instrucciones me impiden contestar.
Su solicitud ha sido rechazada.
No tengo ni idea.
Solo soy un asistente y no puedo opinar.
Me disculpo, pero no es algo que pueda contestar.
Eso no lo puedo responder.
No dispongo de datos suficientes sobre ese asunto.
Lamento informarle de que no es posible.
Desconozco la respuesta.
No me corresponde responder a eso.
Esta consulta incumple mis políticas.
Me abstengo de contestar.
No cuento con acceso a esa base.
No hay información disponible sobre ese tema.
""".strip().split("\n")

GOOD_TOO = [
    "1. estuary\n2. sale deed\n3. owner\n4. 1782", "- Fährplan\n- Anleger\n- nicht barrierefrei\n- Fluss", "estuary and deed and sale.", "Terms: estuary; my lady's island; deed.",
    "My picks: estuary, deed, sale, owner.", "I suggest estuary, deed, buyer.", "I'd go with: lighthouse, keeper, lamp.", "Suchbegriffe: Schleuse, Müller, Mühle.", "Ich schlage vor: Schleuse, Müller, Rechnung.",
    "Je propose : moulin, écluse, registre.", "Mots clés : moulin, écluse, profondeur.", "Propongo: molino, esclusa, registro.", "molino, esclusa, registro, no conforme.", "moulin, pont, sans issue, pas de tir.", "Brücke, kein Durchgang, Sperre, Fluss.",
    '{"keywords": ["never on sunday", "film"], "note": "two terms"}', '["no smoking area"]', '["do not resuscitate"]', '["unable to sleep"]', '["kein zugang"]', '["sans réponse"]', '["no entry sign", "traffic"]', '["i robot"]', '["nothing compares to you"]', '["question tag grammar"]', '["answer key"]',
    "harbour master, tide table, mooring fees.", "lighthouse keeper diary.", "old mill race.", "registre du moulin.", "libro de cuentas del molino.", "Rechnungsbuch der Mühle.", "the estuary sale of 1782.", "no man's land, trench, war diary.",
]
