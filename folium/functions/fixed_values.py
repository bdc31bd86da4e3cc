"""Word lists, patterns and messages that results depend on. Plain data, no logic."""

STOP_WORDS = [
    "a", "ao", "aos", "as", "com", "da", "das", "de", "do", "dos",
    "e", "em", "esta", "este", "foi", "há", "na", "nas", "no", "nos",
    "o", "os", "ou", "para", "por", "que", "se", "sem", "sob", "uma",
    "um", "uso", "usa", "usando", "paciente", "pacientes", "relata",
]

ADMINISTRATIVE = [
    "termo de consentimento", "termo de informacao e consentimento", "consentimento informado",
    "declaro que fui informado", "declaro que fui informada", "autorizo a realizacao",
    "assinatura e carimbo", "assinatura do paciente", "assinatura da paciente",
]

CONSENT_QUESTION = [
    "consentimento", "termo de consentimento", "orientacao pre procedimento",
    "orientacao pos procedimento", "riscos do procedimento", "efeitos adversos do procedimento",
]

PROCEDURE = [
    "mesoterapia", "microagulhamento", "intradermoterapia", "intralesional", "injetavel", "injecao",
    "aplicacao de corticoide", "laser", "led", "plasma rico em plaquetas", "prp",
]

TREATMENT = [
    "tratamento", "conduta", "prescrever", "prescricao", "minoxidil", "finasterida", "dutasterida",
    "espironolactona", "suplementacao", "dose", "mg por dia", "posologia",
]

ASSESSMENT = [
    "anamnese", "investigar", "avaliacao", "exame fisico", "tricoscopia", "dermatoscopia",
    "diagnostico diferencial", "historia clinica", "histórico clinico", "sinais e sintomas",
]

DIAGNOSIS = [
    "diagnostico", "hipotese", "diferencial", "alopecia androgenetica", "efluvio telogeno",
    "dermatite seborreica", "alopecia areata", "alopecia cicatricial",
]

ADVERSE_EVENT = [
    "efeito adverso", "evento adverso", "complicacao", "atrofia", "necrose", "edema", "eritema",
    "reacao alergica", "dor intensa", "agravamento apos", "nodulo", "nodulos", "caroco", "carocos",
    "secrecao", "pus", "abscesso", "granuloma", "infeccao", "calor local",
]

SCARRING = [
    "alopecia cicatricial", "alopecia fibrosante frontal", "liquen plano pilar", "fapd",
    "lupus eritematoso discoide", "fibrose perifolicular", "perda de ostios", "ausencia de orificios foliculares",
]

SCALP = [
    "oleosidade", "oleoso", "descamacao", "escamacao", "escamas", "caspa", "prurido", "coceira",
    "ardor", "ardencia", "vermelhidao", "eritema", "inflamacao", "crostas",
]

HAIR = [
    "coroa", "vertice", "topo", "temporal", "temporas", "frontal", "linha frontal", "rarefacao",
    "afinamento", "miniaturizacao", "padrao feminino", "padrao masculino",
]

MEDICATION = [
    "anticoncepcional", "antidepressivo", "medicamento", "medicamentos", "farmaco", "remedio",
    "isotretinoina", "hormonio", "hormonal",
]

LABS = ["ferritina", "vitamina b12", "vitamina d", "tsh", "hemograma", "exames laboratoriais", "deficiencia"]

ANDROGENETIC = ["alopecia androgenetica", "padrao feminino", "padrao masculino", "miniaturizacao"]
EFFLUVIUM = ["efluvio telogeno", "telogen effluvium"]
AREATA = ["alopecia areata"]

TREATMENT_QUESTION = ["tratamento", "tratar", "conduta", "o que fazer", "terapia", "medicamento", "suplemento", "procedimento"]
DIAGNOSIS_QUESTION = ["diagnostico", "hipotese", "diferencial", "o que pode ser"]
PROCEDURE_SYMPTOMS = [
    "coceira", "prurido", "dor", "dolorido", "nodulo", "caroco", "edema", "inchaco", "vermelhidao",
    "secrecao", "pus", "calor local",
]
PENALISED_SOURCES = ["indicacoes", "beneficios", "intervalo entre sessoes"]

#: First match wins.
SOURCE_HINTS = [
    ("consent_form", ["consentimento", "termo", "autorizacao"]),
    ("guideline", ["guideline", "diretriz", "consenso", "recomendacoes"]),
    ("systematic_review", ["systematic review", "meta-analysis", "metaanalysis"]),
    ("review", ["review", "revisao", "overview"]),
    ("clinical_case", ["caso", "case report", "case series"]),
    ("procedure_protocol", ["protocolo", "procedimento", "mesoterapia", "intralesional", "injection", "injections"]),
]
ARTICLE_MARKS = ["doi", "abstract", "references"]

#: First match wins; matched on raw text, without case.
SECTIONS = [
    (r"\b(conduta|tratamento|terapeutica|terapêutica)\s*:", "treatment"),
    (r"\b(procedimentos?|tecnicas?|técnicas?)\s*:", "procedure"),
    (r"\b(diagnostico|diagnóstico|hipoteses?|hipóteses?)\s*:", "diagnosis"),
    (r"\b(exames?|avaliacao|avaliação|anamnese|investigacao|investigação)\s*:", "assessment"),
    (r"\b(efeitos? colaterais?|eventos? adversos?|complicacoes?|complicações?)\s*:", "adverse_event"),
    (r"\b(observacoes?|observações?|conclusao|conclusão)\s*:", "discussion"),
]
SECTION_START = (
    r"(?:conduta|tratamento|terap[eê]utica|diagn[oó]stico|hip[oó]teses?|exames?|avalia[cç][aã]o|anamnese|procedimentos?|"
    r"efeitos? colaterais?|eventos? adversos?|complica[cç][oõ]es?|observa[cç][oõ]es?)\s*:"
)

TOPICS = [
    ("scarring_alopecia", SCARRING),
    ("androgenetic_alopecia", ANDROGENETIC),
    ("telogen_effluvium", EFFLUVIUM),
    ("alopecia_areata", AREATA),
    ("procedure_complication", ADVERSE_EVENT),
    ("scalp_inflammation", SCALP),
    ("medication_history", MEDICATION),
    ("nutrition_labs", LABS),
]
HIGH_QUALITY = ["guideline", "systematic_review", "review", "scientific_article"]
MEDIUM_QUALITY = ["clinical_case", "educational_material", "procedure_protocol"]

FOCUS = {
    "scalp": "oleosidade descamacao prurido inflamacao do couro cabeludo avaliacao e diagnostico diferencial",
    "hair": "padrao de rarefacao coroa vertice temporas afinamento tricoscopia e diagnostico diferencial",
    "medication": "anamnese medicamentosa nome dose tempo de uso alteracao recente e relacao temporal com a queda",
    "labs": "exames laboratoriais e deficiencias conforme historia clinica",
}
ADVERSE_VARIANT = (
    " evento adverso complicacao pos procedimento prurido coceira nodulos dolorosos reacao inflamatoria reacao alergica "
    "infeccao granuloma abscesso sinais de alerta encaminhamento"
)
INVESTIGATION_VARIANT = " investigacao inicial anamnese exame tricoscopia hipoteses a diferenciar sinais de alerta"
CRITERIA_VARIANT = " criterios indicacoes contraindicacoes riscos e limites da fonte"

#: Matched without case, over line ends, each replaced by a blank.
BOILERPLATE = [
    r"Esse material é rastreável.*?Código Penal Brasileiro\.",
    r"Copyright.{0,4}Lippincott Williams & Wilkins.*?prohibited\.?",
    r"(Todos os direitos reservados|All rights reserved).{0,800}?(sem autorização escrita.*?\.|without written permission.*?\.)",
    r"Nenhuma parte deste (material|livro).{0,600}?(do Editor|Publisher)[^.]*\.",
    r"No part of this (material|book|work).{0,600}?(the Publisher|permission)[^.]*\.",
    r"Conte[uú]do licenciado para.{0,250}?(?:\d{3}\.\d{3}\.\d{3}-\d{2}|$)",
    r"Licenciado para.{0,250}?(?:\d{3}\.\d{3}\.\d{3}-\d{2}|$)",
]
ABBREVIATIONS = ["Dr.", "Dra.", "Prof.", "Profa.", "Sr.", "Sra.", "Fig.", "Figs.", "Eq.", "Eqs.", "p.", "pp.", "vol.", "n.", "no.", "nº."]
#: Dots that end no sentence: of numbers, of "et al." before a reference, of initials.
DOTS_INSIDE = [r"(?<=\d)\.(?=\d)", r"(?i)\bet al\.(?=\s*[,;(]|\s*\d{4})", r"\b[A-Z]\.(?=\s*[A-ZÀ-ÖØ-Þ])"]
#: Where long units are cut, best first.
CUT_AT = ["; ", ": ", ", ", " "]
#: Stands for a paragraph's end while line ends go.
PARAGRAPH = "\ue000"
#: What cleaning replaces in a page's text, in this order.
CLEANING = [
    ("\u00ad", ""),
    (r"(?imuU)^\s*(?:p[aá]gina\s*)?\d{1,4}\s*$", " "),
    (r"(?U)([A-Za-zÀ-ÖØ-öø-ÿ])-\s*\n\s*([A-Za-zÀ-ÖØ-öø-ÿ])", "$1$2"),
    (r"(?imuU)^\s*[•●▪◦*-]\s+", "\n\n- "),
    (r"(?iuU)\s+-\s+(?=[A-ZÀ-ÖØ-Þ])", "\n\n- "),
    (rf"(?iuU)\s+(?={SECTION_START})", "\n\n"),
    (r"\n[ \t]*\n+", PARAGRAPH),
    ("\n", " "),
    (PARAGRAPH, "\n\n"),
    (r"(?U)\|\s*\d{1,4}\s*\|", " "),
    (r"(?U)(?:^|\s)\|\s*\d{1,4}(?=\s)", " "),
    (r"(?U)(?:^|\s)\d{1,4}\s*\|(?=\s)", " "),
    (r"[ \t]{2,}", " "),
    (r" *\n\n *", "\n\n"),
    (r"\n{3,}", "\n\n"),
]
#: File name parts and how many first pages to skip.
SKIPPED_PAGES = {
    "Interventionsforfemalepatternhairloss-Review": 2,
    "TABELATACO-TabelaBrasileiradeComposiodeAlimentos": 10,
    "3BocciOzoneANewMedicalDrugLivroCompleto_Traduzido.en.pt-9": 13,
    "LIVROGuia_uso_medico_OzonoPortugues": 12,
    "madri2020": 15,
    "EBOOKSUPLEMENTACAOCAPILAR": 5,
}

NEXT_STEP_QUESTION = ["como prosseguir", "como proceder", "como conduzir", "o que fazer", "qual a proxima etapa", "qual a conduta"]
CASE_PROCEDURES = ["mesoterapia", "microagulhamento", "injecao", "injetavel", "intralesional", "procedimento", "aplicacao"]
CASE_SYMPTOMS = ["coceira", "prurido", "caroco", "nodulo", "dolorido", "dor", "edema", "inchaco", "vermelh", "secrecao", "pus", "reacao"]
UNSAFE = [
    r"\bprescrev(?:a|er|eu|emos|ido|ida)\b",
    r"\b(?:inicie|iniciar|suspenda|suspender|interrompa|interromper|troque|trocar)\b",
    r"\b(?:dose|posologia)\s*(?:de|:)",
    r"\b\d+(?:[.,]\d+)?\s*(?:mg|mcg|µg|ml)\b",
]
PLAN_HEADING = "como prosseguir agora"
ACTIONS = ["registrar", "observar", "verificar", "examinar", "encaminhar", "avaliacao", "antes de nova sessao"]
CUT_OFF_ENDS = ["a base", "e necessario", "nao permite concluir", "porque", "portanto"]
NO_CITATIONS = "resposta sem citações"
BAD_CITATIONS = "citações inexistentes: "
PRESCRIPTIVE = "linguagem prescritiva ou dose"
NO_PLAN = "faltou responder diretamente como prosseguir"
NO_ACTION = "resposta sem próxima etapa operacional"
CUT_OFF = "resposta possivelmente interrompida"
TRUNCATED = "\n[trecho truncado pelo limite]\n</trecho>"

SENSITIVE_KEYS = [
    "password", "senha", "token", "cookie", "authorization", "question", "pergunta", "answer", "resposta",
    "content", "conteudo", "texto", "patient", "paciente", "cpf", "telefone", "address", "endereco",
]
REMOVED = "[removido]"
UNKNOWN_SOURCE = "Fonte não identificada"
NEW_CHAT_TITLE = "Nova conversa"

#: Why a candidate's score changed or it was rejected.
REASONS = {
    "coverage": "boa cobertura dos termos do caso",
    "consent": "termo de consentimento fora da finalidade da pergunta",
    "high": "fonte de maior hierarquia documental",
    "low": "fonte administrativa ou de baixa utilidade clínica geral",
    "assessment": "conteúdo de avaliação/investigação",
    "diagnosis": "conteúdo de diferenciação diagnóstica",
    "treatment": "conteúdo de tratamento antes da confirmação",
    "procedure": "procedimento não solicitado",
    "adverse_event": "complicação de procedimento não relacionada à pergunta",
    "case_general": "caso semelhante sem orientação de avaliação",
    "protocol": "documento centrado em procedimento não solicitado",
    "case_plan": "risco de transferir conduta de outro caso",
    "case_rejected": "conduta de caso clínico não serve como investigação inicial",
    "scalp": "cobre sinais inflamatórios/descamação",
    "hair": "cobre o padrão/localização da queda",
    "medication": "cobre histórico medicamentoso",
    "labs": "cobre exames/laboratório",
    "procedure_asked": "procedimento solicitado pela consulta",
    "adverse_covered": "cobre possível evento adverso pós-procedimento",
    "adverse_missed": "procedimento genérico sem foco em complicação",
    "adverse_source": "fonte de indicação geral pouco útil para evento adverso",
}
