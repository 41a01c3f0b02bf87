"""Phrase lists of the classifiers."""

# Phrases without accents, lower case, in the order in which matches are reported.

#: Architecture named as such.
EXPLICIT = [
    "servicos de arquitetura",
    "servico de arquitetura",
    "prestacao de servicos de arquitetura",
    "aquisicao de servicos de arquitetura",
    "consultoria de arquitetura",
    "projeto de arquitetura",
    "projetos de arquitetura",
    "projeto arquitetonico",
    "projetos arquitetonicos",
    "projeto arquitetural",
    "projetos arquiteturais",
    "arquitetura e especialidades",
    "arquitetura, engenharia e especialidades",
    "arquitetura e engenharia",
    "projeto de arquitetura e especialidades",
    "projetos de arquitetura e especialidades",
    "projeto de arquitetura e projetos de especialidades",
    "projetos de arquitetura e projetos de especialidades",
    "projeto geral de arquitetura e especialidades",
    "projeto de execucao de arquitetura",
    "projetos de execucao de arquitetura",
    "projeto de execucao de arquitetura e especialidades",
    "projetos de execucao de arquitetura e especialidades",
    "revisao de projeto de arquitetura",
    "revisao de projetos de arquitetura",
    "revisao do projeto de arquitetura",
    "revisao dos projetos de arquitetura",
    "revisao de arquitetura e especialidades",
    "revisao de projetos de arquitetura e especialidades",
    "concurso de concecao de arquitetura",
    "concurso de concepcao de arquitetura",
    "concurso de concecao arquitetonica",
    "concurso de concepcao arquitetonica",
    "arquitetura de interiores",
    "projeto de arquitetura de interiores",
    "servicos de arquitetura de interiores",
    "coordenacao de projeto de arquitetura",
    "coordenacao do projeto de arquitetura",
    "coordenacao de projetos de arquitetura",
    "coordenacao dos projetos de arquitetura",
    "coordenacao de arquitetura e especialidades",
    "coordenacao dos projetos de arquitetura e especialidades",
]

#: Design work.
DESIGN_ACTION = [
    "elaboracao de projeto",
    "elaboracao de projetos",
    "elaboracao do projeto",
    "elaboracao dos projetos",
    "desenvolvimento de projeto",
    "desenvolvimento de projetos",
    "desenvolvimento do projeto",
    "desenvolvimento dos projetos",
    "projeto de execucao",
    "projetos de execucao",
    "anteprojeto",
    "anteprojetos",
    "estudo previo",
    "estudos previos",
    "projeto base",
    "projetos base",
    "revisao de projeto",
    "revisao de projetos",
    "revisao do projeto",
    "revisao dos projetos",
    "concecao de projeto",
    "concecao do projeto",
    "concepcao de projeto",
    "concepcao do projeto",
    "coordenacao de projeto",
    "coordenacao de projetos",
    "coordenacao do projeto",
    "coordenacao dos projetos",
    "equipa projetista",
    "equipa de projeto",
]

#: Coordination of design.
COORDINATION = [
    "coordenacao de projeto",
    "coordenacao de projetos",
    "coordenacao do projeto",
    "coordenacao dos projetos",
    "coordenacao de arquitetura",
    "coordenacao da arquitetura",
    "coordenacao de especialidades",
    "coordenacao das especialidades",
    "coordenacao entre arquitetura e especialidades",
    "coordenacao da equipa projetista",
    "coordenacao de equipa projetista",
]

#: Other meanings of architecture, and other services.
EXCLUSION = [
    "arquitetura de sistemas",
    "arquitetura de software",
    "arquitetura aplicacional",
    "arquitetura empresarial",
    "arquitetura tecnologica",
    "arquitetura de dados",
    "arquitetura de informacao",
    "arquitetura de infraestrutura",
    "engenharia de software",
    "desenvolvimento de software",
    "sistemas aplicacionais",
    "aplicacoes informaticas",
    "infraestruturas informaticas",
    "ciberseguranca",
    "hardware",
    "data center",
    "centro de dados",
    "identidade visual",
    "identidade grafica",
    "design grafico",
    "comunicacao visual",
    "imagem de marca",
    "logotipo",
    "concecao grafica",
    "concepcao grafica",
    "producao grafica",
    "servicos de limpeza",
    "limpeza de edificios",
    "servicos de vigilancia",
    "servicos de catering",
    "fornecimento de refeicoes",
    "fornecimento de combustiveis",
    "aquisicao de combustiveis",
    "fornecimento de mobiliario",
    "aquisicao de mobiliario",
]

#: Supervision of works.
SUPERVISION = [
    "fiscalizacao de obra",
    "fiscalizacao da obra",
    "fiscalizacao das obras",
    "fiscalizacao de obras",
    "fiscalizacao de empreitada",
    "fiscalizacao da empreitada",
    "fiscalizacao das empreitadas",
    "fiscalizacao de empreitadas",
    "servicos de fiscalizacao",
    "prestacao de servicos de fiscalizacao",
    "aquisicao de servicos de fiscalizacao",
    "direcao de fiscalizacao",
    "direcao da fiscalizacao",
    "coordenacao de seguranca em obra",
    "coordenacao de seguranca na obra",
    "coordenacao de seguranca da obra",
    "coordenacao de seguranca das obras",
    "coordenacao de seguranca em empreitada",
    "coordenacao de seguranca na empreitada",
    "coordenacao de seguranca da empreitada",
    "coordenacao de seguranca das empreitadas",
    "gestao da empreitada",
    "gestao de empreitada",
    "gestao das empreitadas",
    "gestao de empreitadas",
    "gestao de qualidade da empreitada",
    "gestao da qualidade da empreitada",
    "controlo de qualidade da obra",
    "controlo de qualidade da empreitada",
    "coordenacao de gestao ambiental da empreitada",
    "coordenacao ambiental da empreitada",
    "acompanhamento de obra",
    "acompanhamento da obra",
    "acompanhamento de obras",
    "acompanhamento das obras",
    "acompanhamento da empreitada",
    "acompanhamento de empreitada",
    "supervisao de obra",
    "supervisao da obra",
]

#: Engineering without architecture.
ENGINEERING = [
    "abastecimento de agua",
    "rede de abastecimento de agua",
    "rede de agua",
    "redes de agua",
    "rede de saneamento",
    "redes de saneamento",
    "saneamento de aguas residuais",
    "ciclo urbano da agua",
    "infraestruturas de agua",
    "infraestruturas hidraulicas",
    "sistemas hidraulicos",
    "conduta",
    "condutas",
    "adutora",
    "adutoras",
    "pipeline",
    "pipelines",
    "etar",
    "estacao de tratamento de aguas residuais",
    "estacao de tratamento de agua",
    "rede viaria",
    "infraestruturas rodoviarias",
    "estrada",
    "estradas",
    "caminho municipal",
    "caminhos municipais",
    "caminhos rurais",
    "repavimentacao",
    "pavimentacao",
    "variante rodoviaria",
    "sinalizacao rodoviaria",
    "drenagem rodoviaria",
    "estabilizacao de taludes",
    "protecao costeira",
    "protecao da orla costeira",
    "dunas",
    "esporao",
    "esporoes",
    "barragem",
    "barragens",
    "assoreamento",
    "instalacoes eletricas",
    "instalacoes mecanicas",
    "instalacoes tecnicas",
    "eficiencia energetica",
    "rede de gas",
    "redes de gas",
]

#: Prefilter: words that suffice.
STRONG_WORDS = [
    "arquitetura",
    "arquitectura",
    "arquitetonico",
    "arquitectonico",
    "arquiteto",
    "urbanismo",
    "urbanistico",
    "planeamento urbano",
    "plano de urbanizacao",
    "plano de pormenor",
    "projeto de arquitetura",
    "projecto de arquitectura",
    "estudo previo",
    "levantamento arquitetonico",
    "projeto de execucao",
    "projecto de execucao",
    "concurso de concecao",
    "concurso de concepcao",
    "concurso de ideias",
    "projetista",
]

#: Prefilter: design.
PROJECT_WORDS = [
    "elaboracao de projeto",
    "elaboracao do projeto",
    "elaboracao de projetos",
    "prestacao de servicos para elaboracao",
    "prestacao de servicos de elaboracao",
    "projeto para",
    "projeto da",
    "projeto do",
    "projeto de",
    "projetos de",
    "projeto geral",
    "projeto integrado",
    "projeto de especialidades",
    "projetos de especialidades",
    "estudos e projetos",
    "estudo e projeto",
    "projeto base",
    "projeto de licenciamento",
    "assistencia tecnica ao projeto",
    "revisao de projeto",
]

#: Prefilter: buildings, with a service.
BUILDING_WORDS = [
    "requalificacao",
    "reabilitacao",
    "remodelacao",
    "ampliacao",
    "beneficiacao",
    "reconversao",
    "recuperacao",
    "conservacao",
    "adaptacao",
    "modernizacao",
    "construcao",
    "edificio",
    "edificios",
    "equipamento",
    "equipamentos",
    "escola",
    "escolar",
    "jardim de infancia",
    "creche",
    "biblioteca",
    "museu",
    "mercado municipal",
    "pavilhao",
    "centro cultural",
    "centro comunitario",
    "centro de saude",
    "unidade de saude",
    "habitacao",
    "habitacional",
    "residencia",
    "instalacoes",
    "quartel",
    "auditorio",
    "teatro",
    "arquivo",
    "complexo desportivo",
    "piscina",
    "cemiterio",
    "espaco publico",
    "praca",
    "parque urbano",
    "arranjo urbanistico",
    "arranjo paisagistico",
]

#: Prefilter: services, with a building.
SERVICE_WORDS = [
    "fiscalizacao",
    "coordenacao de seguranca",
    "gestao de projeto",
    "consultoria de arquitetura",
    "consultoria tecnica",
    "equipa projetista",
    "equipa de projeto",
    "estudo de viabilidade",
    "programa preliminar",
    "programa base",
    "levantamento de edificios",
    "diagnostico do edificado",
]

#: Prefilter: literal phrases.
COMPETITION_WORDS = [
    "concurso de concecao",
    "concurso de ideias",
]

#: Weights of a title score; PASS_SCORE passes.
WEIGHTS = {
    "arquitetura": 50,
    "arquitectura": 50,
    "projeto de arquitetura": 60,
    "projecto de arquitectura": 60,
    "serviços de arquitetura": 60,
    "concurso de conceção": 55,
    "concurso de concepção": 55,
    "elaboração de projeto": 35,
    "elaboração de projecto": 35,
    "reabilitação": 20,
    "requalificação": 20,
    "escola": 15,
    "centro de saúde": 15,
    "museu": 15,
    "habitação": 15,
    "espaço público": 15,
    "limpeza": -80,
    "combustível": -80,
    "software": -70,
    "seguros": -70,
    "mobiliário": -40,
    "manutenção": -30,
    "empreitada": -25,
}
PASS_SCORE = 30

#: Category of a title: the first entry with a part that is in it, accents counting.
CATEGORIES = {
    "Escolas": ["escola", "educa"],
    "Habitação": ["habita", "resid"],
    "Saúde": ["saúde", "hospital"],
    "Espaço público": ["praça", "largo", "rua", "espaço público"],
    "Paisagismo": ["jardim", "parque", "paisag"],
    "Cultura": ["cultura", "teatro", "biblioteca", "centro cultural"],
    "Equipamentos públicos": ["equipamento público", "equipamento municipal", "edifício municipal", "serviços municipais"],
    "Mobilidade": ["mobilidade", "estação", "terminal", "metro", "ferrovi", "ciclovia"],
    "Património": ["patrim", "museu"],
}
OTHER_CATEGORY = "Outros"

#: Badge of a title on a card, likewise.
BADGES = {
    "Escolas": ["escola", "educa"],
    "Habitação": ["habita", "resid"],
    "Paisagismo": ["jardim", "paisag"],
    "Espaço público": ["praça", "largo", "rua"],
    "Saúde": ["saúde", "hospital"],
    "Património": ["patrim", "museu"],
}
OTHER_BADGE = "Arquitetura"

#: Service of title and procedure, accents not counting.
SERVICES = {
    "Fiscalização / Coordenação": ["fiscalizacao", "coordenacao de seguranca", "coordenacao"],
    "Revisão / Análise de projeto": ["revisao", "analise de projeto", "verificacao de projeto"],
    "Concurso de conceção": ["concurso de concecao", "concurso de concepcao"],
    "Elaboração de projeto": ["elaboracao de projeto", "projeto de arquitetura", "projecto de arquitectura", "projeto"],
}

#: Kinds of contract, and the reasons that a classification reports, in order.
SERVICE_CONTRACTS = ["aquisicao de servicos", "prestacao de servicos"]
WORKS_CONTRACTS = ["empreitada"]
REASONS = {
    "service": "contrato de aquisição ou prestação de serviços",
    "explicit": "referência explícita a arquitetura",
    "by_cpv": "CPV 712 acompanhado por ação de projeto",
    "coordination": "coordenação relacionada com projeto",
    "blocked": "serviço de fiscalização, obra ou exclusão forte",
    "engineering": "projeto de engenharia sem arquitetura explícita",
}

MONTHS = ["Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro"]
