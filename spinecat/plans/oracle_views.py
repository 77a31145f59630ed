"""The adapter views of ``adapters.py`` as DuckDB common table expressions."""

from __future__ import annotations

from spinecat import schemas


def fold(expr: str) -> str:
    return rf"regexp_replace(strip_accents({expr}), '[^\x00-\x7F]', '', 'g')"


def key(expr: str) -> str:
    return f"trim(regexp_replace(lower({fold(expr)}), '[^a-z0-9]+', ' ', 'g'))"


def normal(expr: str) -> str:
    lowered = f"lower({fold(expr)})"
    return (
        rf"regexp_replace(regexp_replace({lowered}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g'),"
        r" '[\s\x1c-\x1f]+', ' ', 'g')"
    )


def slug(expr: str) -> str:
    dashed = f"trim(regexp_replace(lower({fold(expr)}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif({dashed}, ''), 'libreria')"


def main_title(expr: str) -> str:
    head = key(f"regexp_extract({expr}, '(?s)^(.*?)([:;]| - | — | – |$)', 1)")
    return f"CASE WHEN {head} <> {key(expr)} THEN {head} ELSE '' END"


def search_form(expr: str) -> str:
    return f"trim(lower(strip_accents(coalesce({expr}, ''))))"


def _day(col: str) -> str:
    return (
        f"(TIMESTAMP '2024-01-01' + to_days(CAST(date_diff('day', DATE '1995-01-01', "
        f"CAST({col} AS DATE)) % 30 AS INTEGER)))"
    )


def nothing(member: str) -> str:
    """Truth rule of payload members; ``member`` is a JSON text or NULL."""
    return (
        f"coalesce(regexp_full_match({member}, "
        r"'null|false|\"\"|\[\]|\{\}|-?0+(\.0*)?([eE][+-]?\d+)?'), true)"
    )


def member(name: str, payload: str = "payload") -> str:
    return f"CAST(json_extract({payload}, '$.{name}') AS VARCHAR)"


def text_member(name: str, payload: str = "payload") -> str:
    return (
        f"CASE WHEN json_type({payload}, '$.{name}') = 'VARCHAR' "
        f"THEN json_extract_string({payload}, '$.{name}') END"
    )


N = "(SELECT count(*) FROM supplier)"
TEMPLATE = schemas.DEFAULT_TEMPLATE
K = "CAST(json_extract(props, '$.k') AS INTEGER)"

VIEWS: dict[str, tuple[list[str], str]] = {
    "librerias": (
        [],
        f"""SELECT s_suppkey AS id, {slug('s_name')} AS slug, s_name AS nombre,
        '549' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS whatsapp,
        '{TEMPLATE}' AS mensaje_wa_template,
        TIMESTAMP '2023-12-01' + to_days(CAST(s_suppkey % 28 AS INTEGER)) AS creado_en,
        s_acctbal >= 0 AS activa FROM supplier""",
    ),
    "lotes": (
        [],
        f"""SELECT o_orderkey AS id, o_custkey % {N} AS libreria_id,
        CASE o_orderstatus WHEN 'F' THEN 'publicado' WHEN 'O' THEN 'revision'
             ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'descartado' ELSE 'procesando' END
        END AS estado,
        coalesce(c.n, 0) AS cant_fotos, {_day('o_orderdate')} AS creado_en,
        CASE WHEN o_orderstatus = 'F' THEN {_day('o_orderdate')} + INTERVAL 1 DAY END
            AS publicado_en,
        CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '2024-02-15' END AS archivado_en
        FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n
            FROM lineitem GROUP BY l_orderkey) c ON c.l_orderkey = o_orderkey""",
    ),
    "fotos": (
        [],
        """SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS lote_id,
        l_orderkey || '/' || (l_linenumber - 1) || '.jpg' AS path, l_linenumber - 1 AS orden
        FROM lineitem""",
    ),
    "lineas": (
        [],
        f"""SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey,
            l_linenumber, CAST(floor(l_quantity * 100 + 0.5) AS BIGINT),
            CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT),
            CAST(floor(l_discount * 100 + 0.5) AS BIGINT), CAST(floor(l_tax * 100 + 0.5) AS BIGINT),
            l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))), 1, 15) AS BIGINT) AS id,
        l_orderkey AS lote_id, l_orderkey * 10 + l_linenumber AS foto_id,
        l_linenumber - 1 AS orden,
        CASE l_partkey % 4 WHEN 0 THEN replace(p_name, 'a', 'á') WHEN 1 THEN upper(p_name) || '.'
            WHEN 2 THEN p_name || ': ' || lower(p_type) ELSE p_name || ' ' || p_size END AS titulo,
        CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'Ana ' || lower(p_type) END AS autor,
        l_suppkey % 3 = 0 AS en_mayusculas,
        floor(l_discount * 100 + 0.5) / 10 AS confianza,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'pendiente'
             WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'descartado'
             WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'vendido'
             ELSE 'publicado' END AS estado,
        l_partkey, p_brand, {_day('l_shipdate')} AS creado_en
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    ),
    "libros": (
        ["lineas", "lotes"],
        """SELECT r.id, b.libreria_id, r.lote_id, r.foto_id, r.orden,
        CASE WHEN en_mayusculas THEN upper(titulo) ELSE titulo END AS titulo_raw,
        autor AS autor_raw, titulo, autor, confianza, r.estado, r.creado_en,
        CASE WHEN r.estado IN ('publicado', 'vendido') THEN r.creado_en + INTERVAL 1 DAY END
            AS publicado_en,
        CASE WHEN r.estado = 'vendido' THEN r.creado_en + INTERVAL 7 DAY END AS vendido_en,
        CASE WHEN r.estado = 'descartado' AND l_partkey % 2 = 0 AND f.primero <> r.id
            THEN f.primero END AS duplicado_de,
        b.archivado_en,
        CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Coleccion ' || p_brand ELSE autor END
            AS autor_leido
        FROM lineas r JOIN lotes b ON b.id = r.lote_id
        JOIN (SELECT lote_id, min(id) AS primero FROM lineas GROUP BY lote_id) f
            ON f.lote_id = r.lote_id""",
    ),
    "eventos": (
        [],
        f"""SELECT id, libreria_id, tipo, CASE tipo
        WHEN 'vista' THEN CASE WHEN k % 3 = 0 THEN '{{"src":"qr"}}' ELSE '{{"src":"link"}}' END
        WHEN 'busqueda' THEN CASE WHEN k % 10 = 9 THEN '{{"q":" Term' || (k % 20) || ' "}}'
            ELSE '{{"q":" Term' || (k % 20) || ' ","resultados":' || CASE k % 20 WHEN 1 THEN '"1"'
                WHEN 2 THEN 'true' ELSE CAST(k % 4 AS VARCHAR) END || '}}' END
        WHEN 'clic_whatsapp' THEN CASE k % 5
            WHEN 0 THEN '{{"libro_id":null,"generico":true,"q":"t"}}'
            WHEN 1 THEN '{{"libro_id":' || k || ',"titulo":"","generico":false}}'
            ELSE CASE WHEN k % 30 = 7 THEN '{{"libro_id":' || k || ',"titulo":1984}}'
            ELSE '{{"libro_id":' || k || ',"titulo":"Libro ' || (k % 30) || '"}}' END END
        WHEN 'lote_publicado' THEN '{{"lote_id":' || k || ',"publicados":' || (k % 12) || '}}'
        WHEN 'inventario_reiniciado' THEN '{{"libros_archivados":' || k || '}}'
        ELSE '{{}}' END AS payload,
        CASE WHEN tipo IN ('lote_publicado', 'inventario_reiniciado') THEN NULL
             WHEN k % 13 = 0 THEN ''
             ELSE user_id || '-' || strftime(creado_en, '%Y-%m-%d') END AS session_id,
        creado_en
        FROM (SELECT event_id AS id, user_id, user_id % {N} AS libreria_id, ts AS creado_en, {K} AS k,
            CASE event_type WHEN 'view' THEN 'vista' WHEN 'click' THEN 'clic_whatsapp'
                WHEN 'error' THEN 'busqueda' WHEN 'signup' THEN 'lote_publicado'
                ELSE CASE WHEN {K} % 2 = 0 THEN 'scan_qr' ELSE 'inventario_reiniciado' END
            END AS tipo FROM events)""",
    ),
    "marcas": (
        ["eventos"],
        f"""SELECT id, libreria_id, tipo, session_id, creado_en,
        tipo = 'vista' AND coalesce({member('src')} = '"qr"', false) AS es_qr,
        tipo = 'busqueda' AND {nothing(member('resultados'))} AS sin_resultado,
        tipo = 'clic_whatsapp' AND NOT {nothing(member('generico'))} AS generico,
        CASE WHEN tipo = 'busqueda' THEN lower(trim({text_member('q')})) END AS termino,
        CASE WHEN tipo = 'clic_whatsapp' AND NOT {nothing(member('titulo'))}
            THEN json_extract_string(payload, '$.titulo') END AS titulo,
        CASE WHEN tipo = 'lote_publicado'
            THEN TRY_CAST({member('publicados')} AS BIGINT) END AS publicados
        FROM eventos""",
    ),
    "eventos_raw": (
        ["eventos", "librerias"],
        """SELECT e.id, CASE WHEN e.id % 17 = 0 THEN 'no-existe' ELSE l.slug END AS slug,
        e.tipo, e.payload, e.session_id, e.creado_en
        FROM eventos e JOIN librerias l ON l.id = e.libreria_id""",
    ),
    "ediciones": (
        ["libros"],
        """SELECT id AS libro_id, '  ' || titulo || ' ' AS titulo, autor || ' ' AS autor,
        (['pendiente', 'publicado', 'descartado', 'vendido', 'perdido'])[orden % 5 + 1] AS estado,
        creado_en + INTERVAL 2 DAY AS ts FROM libros
        UNION ALL
        SELECT id, titulo || ' II', autor,
        CASE WHEN estado = 'pendiente' THEN 'publicado' ELSE 'vendido' END,
        creado_en + INTERVAL 4 DAY FROM libros WHERE estado IN ('pendiente', 'descartado')
        UNION ALL
        SELECT id, titulo || ' III', autor, 'perdido', creado_en + INTERVAL 6 DAY
        FROM libros WHERE orden % 3 = 1""",
    ),
    "altas": (
        [],
        f"""SELECT c_custkey AS solicitud,
        CASE WHEN c_custkey % 10 = 7 THEN '  Sup#' || d ELSE ' ' || c_name || ' ' END AS nombre,
        CASE c_custkey % 9 WHEN 4 THEN '011-4444-5555' WHEN 5 THEN ' 54' || d WHEN 6 THEN d
            ELSE '549' || d END AS whatsapp,
        CASE c_custkey % 10 WHEN 3 THEN 'Supplier ' || d WHEN 5 THEN c_mktsegment
            ELSE '' END AS slug,
        CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Hola {{titulo}} ' ELSE '{TEMPLATE}' END
            AS mensaje_wa_template
        FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d FROM customer)""",
    ),
    "consultas": (
        [],
        f"""SELECT event_id AS consulta_id, user_id % {N} AS libreria_id,
        CASE WHEN k % 10 = 9 THEN '   '
            WHEN k % 5 = 0 THEN replace(upper(p_name), 'A', 'Á')
            WHEN k % 5 = 1 THEN right(p_name, 5)
            WHEN k % 5 = 2 THEN 'na ' || lower(substr(p_type, 1, 4))
            WHEN k % 5 = 3 THEN left(p_name, 2)
            ELSE ' Term' || (k % 20) || ' ' END AS q
        FROM (SELECT *, {K} AS k FROM events WHERE event_type = 'error')
        JOIN part ON p_partkey = event_id % (SELECT count(*) FROM part)""",
    ),
    "respuestas": (
        ["lineas"],
        """SELECT 'modelo-' || (foto_id % 4) AS modelo, lote_id, foto_id,
        foto_id % 17 <> 0 AS legible, libros,
        len(libros) * 0.001 AS costo, 500 + foto_id % 1000 AS latencia_ms
        FROM (SELECT lote_id, foto_id, list({'id': id,
                'titulo_detectado': CASE WHEN en_mayusculas THEN upper(titulo) ELSE titulo END,
                'autor_detectado': CASE l_partkey % 7 WHEN 0 THEN ''
                    WHEN 1 THEN 'Coleccion ' || p_brand ELSE autor END,
                'titulo_corregido': CASE length(titulo) % 13 WHEN 5 THEN '   ' WHEN 6 THEN ''
                    ELSE titulo END, 'autor_corregido': autor,
                'confianza': confianza} ORDER BY id) AS libros
            FROM lineas GROUP BY lote_id, foto_id)""",
    ),
    "detecciones": (
        ["respuestas"],
        """SELECT modelo, lote_id, foto_id, pos - 1 AS pos, libro.titulo_detectado AS titulo_detectado,
        libro.autor_detectado AS autor_detectado,
        CASE WHEN libro.titulo_corregido = '' THEN libro.titulo_detectado
            ELSE trim(libro.titulo_corregido) END AS titulo_corregido,
        CASE WHEN frenado THEN '' ELSE libro.autor_corregido END AS autor_corregido,
        CASE WHEN frenado THEN least(libro.confianza, 0.4) ELSE libro.confianza END AS confianza,
        CASE WHEN frenado THEN libro.autor_corregido END AS autor_descartado
        FROM (SELECT *, libro.autor_corregido <> '' AND (libro.autor_detectado = ''
                OR starts_with(libro.autor_detectado, 'Coleccion ')) AS frenado
            FROM (SELECT modelo, lote_id, foto_id, generate_subscripts(libros, 1) AS pos,
                unnest(libros) AS libro FROM respuestas WHERE legible))""",
    ),
}


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """Prefix a statement with the views it needs, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for dep in VIEWS[name][0]:
                add(dep)
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in ordered)
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {ctes}\n{body}" if not body.lstrip().startswith(",") else f"{word} {ctes}{body}"
