"""Stop words and sentiment terms.

These lists must equal the published ones for detection and scoring to agree, so they are given
as plain text. Both sentiment lists can be replaced: every function takes its own table.
"""

# Stop words, Portuguese.
STOP_PT = """
a à ao aos as até com como da das de del dem depois do dos e é em entre era essa esse esta este eu
foi isso isto já lhe lhes lo mais mas me meu meus minha minhas muito na nas não nem no nos num numa
o os ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus sua suas são também
te teu teus tu tua tuas um uma uns umas você vocês
""".split()

# Stop words, English.
STOP_EN = """
a an the and or but in on at to for of with by from as is was are were be been being have has had
do does did will would could should may might shall can need it its he she they them his her their
this that these those i you we my your our not no so if then than too very just about above after
again all also any because before between both each few more most other some such into only own
same up out down off over under further once here there when where why how what which who whom
""".split()

# Sentiment terms, English.
POSITIVE_EN = """
love, loved, loving, great, excellent, amazing, awesome, fantastic, wonderful, perfect, brilliant,
outstanding, superb, impressive, impressed, best, better, good, very good, really good, nice, solid,
reliable, fast, quick, easy, easy to use, seamless, smooth, helpful, friendly, convenient,
intuitive, recommend, recommended, highly recommend, would recommend, worth it, happy, satisfied,
pleased, thank you, thanks, kudos, works well, works great, no fees, well done, five stars, 5 stars,
like it, liked it, enjoy, enjoyed
"""
NEGATIVE_EN = """
not recommended, do not recommend, don't recommend, dont recommend, would not recommend,
wouldn't recommend, not good, not great, not happy, not satisfied, not worth it, not working,
doesn't work, does not work, didn't work, did not work, never works, stopped working, bad, worst,
worse, terrible, horrible, awful, poor, useless, garbage, trash, scam, fraud, rip off, ripoff,
ripped off, stole, stolen, disappointed, disappointing, disappointment, frustrated, frustrating,
annoying, annoyed, angry, furious, hate, hated, problem, problems, issue, issues, error, errors,
bug, bugs, buggy, glitch, crash, crashes, crashed, crashing, slow, laggy, broken, blocked,
locked out, frozen, unfair, hidden fees, overcharged, overcharge, charged twice, double charged,
no response, no support, unhelpful, rude, ignored, waste of time, waste of money, never again,
avoid, beware, warning, complaint, complaints, refund, one star, 1 star, zero stars
"""

# Sentiment terms, Portuguese.
POSITIVE_PT = """
adorei, adoro, amei, amo, amamos, ótimo, ótima, ótimos, ótimas, otimo, otima, excelente, excelentes,
maravilhoso, maravilhosa, perfeito, perfeita, incrível, incriveis, incríveis, sensacional,
fantástico, fantástica, top, show, nota 10, nota dez, recomendo, recomendamos, super recomendo,
recomendadíssimo, satisfeito, satisfeita, feliz, confiável, confiavel, rápido, rápida, prático,
prática, fácil, facil, bom, boa, bons, boas, muito bom, muito boa, melhor, melhores, gostei,
gostamos, funciona bem, atendimento excelente, atendimento ótimo, sem taxas, vale a pena, parabéns,
parabens, obrigado, obrigada, eficiente, ajudou, resolveu, resolvido, elogio, elogios
"""
NEGATIVE_PT = """
não recomendo, nao recomendo, não gostei, nao gostei, não funciona, nao funciona, não resolve,
nao resolve, não resolveu, nao resolveu, não vale a pena, nao vale a pena, péssimo, péssima,
pessimo, pessima, horrível, horrivel, terrível, terrivel, ruim, ruins, pior, piores, lixo, vergonha,
vergonhoso, absurdo, abusivo, abusiva, golpe, fraude, roubo, roubaram, enganação, enganacao,
propaganda enganosa, descaso, decepção, decepcao, decepcionado, decepcionada, decepcionante,
frustrado, frustrada, frustrante, insatisfeito, insatisfeita, problema, problemas, erro, erros,
falha, falhas, bug, bugs, travando, travou, trava, lento, lenta, demora, demorado, demorada,
demorando, bloqueado, bloqueada, bloquearam, bloqueio, cancelaram, cancelamento indevido,
cobrança indevida, cobranca indevida, cobraram, taxa abusiva, juros abusivos, juros altos,
reclamação, reclamacao, reclamar, reclamando, ninguém resolve, ninguem resolve, sem resposta,
sem suporte, suporte péssimo, atendimento péssimo, atendimento ruim, atendimento horrível, odeio,
odiei, detesto, raiva, nunca mais, arrependido, arrependida, cuidado, fujam, fuja
"""


def _terms(block):
    return [term.strip() for term in block.replace("\n", " ").split(",") if term.strip()]


def sentiment_terms() -> dict:
    """Term to +1 or -1, English and Portuguese together."""
    table = {}
    for block, polarity in (
        (POSITIVE_EN, 1), (NEGATIVE_EN, -1), (POSITIVE_PT, 1), (NEGATIVE_PT, -1),
    ):
        table.update(dict.fromkeys(_terms(block), polarity))
    return table
