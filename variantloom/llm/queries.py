"""The queries of this package and the SQL that must give the same rows."""

from variantloom.llm import bpe, chat, classlm, dualtree, html, licenses, partenum, phrases, pii, quality, secrets, whitening, winnow

QUERIES = {
    "op1_classlm": classlm.op1_classlm,
    "op2_secrets": secrets.op2_secrets,
    "op3_quality": quality.op3_quality,
    "op4_partenum": partenum.op4_partenum,
    "op5_phrases": phrases.op5_phrases,
    "op6_chat": chat.op6_chat,
    "op7_licenses": licenses.op7_licenses,
    "op8_html": html.op8_html,
    "op9_winnow": winnow.op9_winnow,
    "op10_bpe": bpe.op10_bpe,
    "op11_feast": whitening.op11_feast,
    "op12_skipchain": pii.op12_skipchain,
    "op13_dualtree": dualtree.op13_dualtree,
}
ORACLES = {"op7_licenses": licenses.oracle(), "op9_winnow": winnow.ORACLE, "op13_dualtree": dualtree.ORACLE}
