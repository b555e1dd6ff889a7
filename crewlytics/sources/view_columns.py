"""Column definitions of the workforce views over the star-schema tables.

Every definition is plain SQL understood by Spark and by the checking engine, so
the derived test inputs are the same on both sides.  ``o c n r l s p d e`` are the
aliases of orders, customer, nation, region, lineitem, supplier, part or personnel,
the two-step copy and events; see ``derived.py`` for the joins.
"""

PERSONNEL = {
    "emp_id": "o.o_orderkey",
    "full_name": "concat(c.c_name, '/', CAST(o.o_orderkey AS VARCHAR(20)))",
    "company": "r.r_name",
    "location": "n.n_name",
    "department": "c.c_mktsegment",
    "dept_code": "substr(c.c_mktsegment, 1, 3)",
    "position": "CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderpriority END",
    "position_title": "upper(o.o_orderpriority)",
    "org_ref": "CASE WHEN o.o_orderkey % 20 = 0 THEN '2' ELSE '1' END",
    "is_active": "CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 1 END",
    "is_regular": "CASE WHEN o.o_orderkey % 12 = 0 THEN 0 ELSE 1 END",
    "staff_type": (
        "CASE WHEN o.o_orderkey % 24 = 0 THEN 'Stajyer' WHEN o.o_orderkey % 12 = 0 THEN 'Çırak' "
        "ELSE 'Kadrolu' END"
    ),
    "is_hire": "CASE WHEN o.o_orderkey % 19 = 0 THEN 1 ELSE 0 END",
    "is_leaver": "CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END",
    "gender": "CASE WHEN o.o_custkey % 3 = 0 THEN 'KADIN' ELSE 'ERKEK' END",
    "is_disabled": "CASE WHEN o.o_orderkey % 31 = 0 THEN 1 ELSE 0 END",
    "disability_degree": "CASE WHEN o.o_orderkey % 62 = 0 THEN '60' WHEN o.o_orderkey % 31 = 0 THEN '40' END",
    "age": (
        "CASE WHEN o.o_orderkey % 41 = 0 THEN NULL "
        "ELSE CAST(15 + (o.o_orderkey * 7 + o.o_custkey) % 50 AS INT) END"
    ),
    "age_band": (
        "CASE WHEN o.o_orderkey % 41 = 0 OR o.o_orderkey % 17 = 0 THEN NULL "
        "WHEN (15 + (o.o_orderkey * 7 + o.o_custkey) % 50) <= 18 THEN '15-18' "
        "WHEN (15 + (o.o_orderkey * 7 + o.o_custkey) % 50) <= 29 THEN '19-29' "
        "WHEN (15 + (o.o_orderkey * 7 + o.o_custkey) % 50) <= 39 THEN '30-39' "
        "WHEN (15 + (o.o_orderkey * 7 + o.o_custkey) % 50) <= 49 THEN '40-49' ELSE '50+' END"
    ),
    "education": (
        "CASE o.o_orderkey % 13 WHEN 0 THEN 'DOKTORA' WHEN 1 THEN 'YÜKSEK LİSANS' "
        "WHEN 2 THEN 'LİSANS' WHEN 3 THEN 'ÖN LİSANS' WHEN 4 THEN 'LİSE' "
        "WHEN 5 THEN 'MESLEK LİSESİ' WHEN 6 THEN 'İLKÖĞRETİM' WHEN 7 THEN 'ORTAOKUL' "
        "WHEN 8 THEN 'İLKOKUL' WHEN 9 THEN 'OKUR YAZAR' WHEN 10 THEN 'BİLGİ GİRİLMEMİŞ!!' "
        "WHEN 11 THEN NULL WHEN 12 THEN 'LİSANS' END"
    ),
    "education_level": "CAST(o.o_orderkey % 13 AS VARCHAR(20))",
    "blood_type": (
        "CASE o.o_custkey % 11 WHEN 0 THEN 'A+' WHEN 1 THEN 'A-' WHEN 2 THEN 'B+' WHEN 3 THEN 'B-' "
        "WHEN 4 THEN 'AB+' WHEN 5 THEN 'AB-' WHEN 6 THEN 'O+' WHEN 7 THEN 'O-' WHEN 8 THEN NULL "
        "WHEN 9 THEN 'BİLGİ GİRİLMEMİŞ!!' WHEN 10 THEN ' BİLGİ GİRİLMEMİŞ!! ' END"
    ),
    "marital_status": (
        "CASE o.o_orderkey % 5 WHEN 0 THEN 'EVLİ' WHEN 1 THEN 'EVLİ' WHEN 2 THEN 'BEKAR' "
        "WHEN 3 THEN 'BOŞANMIŞ' WHEN 4 THEN NULL END"
    ),
    "child_flag": (
        "CASE o.o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '1' WHEN 2 THEN '1' WHEN 3 THEN '0' "
        "WHEN 4 THEN '0' WHEN 5 THEN '0' WHEN 6 THEN NULL END"
    ),
    "staff_group": (
        "CASE o.o_orderkey % 8 WHEN 0 THEN 'Mavi Yaka' WHEN 1 THEN 'Mavi Yaka' "
        "WHEN 2 THEN 'Mavi Yaka' WHEN 3 THEN 'Beyaz Yaka' WHEN 4 THEN 'Beyaz Yaka' "
        "WHEN 5 THEN 'Diğer' WHEN 6 THEN 'Mavi Yaka' WHEN 7 THEN NULL END"
    ),
    "employment_status": (
        "CASE o.o_orderkey % 6 WHEN 0 THEN 'Kadrolu' WHEN 1 THEN 'Kadrolu' WHEN 2 THEN 'Kadrolu' "
        "WHEN 3 THEN 'Sözleşmeli' WHEN 4 THEN 'Sözleşmeli' WHEN 5 THEN NULL END"
    ),
    "duty_place": "CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE n.n_name END",
    "residence_city": (
        "CASE o.o_custkey % 11 WHEN 0 THEN 'ADANA' WHEN 1 THEN 'ADIYAMAN' WHEN 2 THEN 'ANKARA' "
        "WHEN 3 THEN 'ANTALYA' WHEN 4 THEN 'BURSA' WHEN 5 THEN 'İSTANBUL' WHEN 6 THEN 'İZMİR' "
        "WHEN 7 THEN 'KOCAELİ' WHEN 8 THEN 'KONYA' WHEN 9 THEN NULL "
        "WHEN 10 THEN 'BİLGİ GİRİLMEMİŞ!!' END"
    ),
    "duty_city": (
        "CASE o.o_custkey % 7 WHEN 0 THEN 'ADANA' WHEN 1 THEN 'ANKARA' WHEN 2 THEN 'İSTANBUL' "
        "WHEN 3 THEN 'İZMİR' WHEN 4 THEN 'KIRŞEHİR' WHEN 5 THEN NULL WHEN 6 THEN 'BURSA' END"
    ),
    "district": "concat('MAH-', CAST(o.o_custkey % 97 AS VARCHAR(20)))",
}

PERSONNEL_MONTH = {
    "year_month": "CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS VARCHAR(20))",
    "org_ref": "p.org_ref",
    "company": "p.company",
    "location": "p.location",
    "full_name": "p.full_name",
    "position": "p.position",
    "education": "p.education",
    "is_hire": "CASE WHEN l.l_linenumber = 1 THEN 1 ELSE 0 END",
    "is_leaver": "CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber > 3 THEN 1 ELSE 0 END",
    "left_unit": "CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END",
}

ENGAGEMENT = {
    "org_ref": "p.org_ref",
    "company": "p.company",
    "location": "p.location",
    "department": "p.department",
    "dept_code": "p.dept_code",
    "full_name": "p.full_name",
    "position": "p.position",
    "gender": "p.gender",
    "age": "p.age",
    "age_band": "p.age_band",
    "marital_status": "p.marital_status",
    "education": "p.education",
    "work_duration": "CASE WHEN p.emp_id % 37 = 0 THEN NULL ELSE CAST(p.emp_id % 241 AS DECIMAL(10,2)) END",
    "leave_duration": "CASE WHEN p.is_active = 1 THEN NULL ELSE CAST(p.emp_id % 61 AS DECIMAL(10,2)) END",
}

TRAINING_EVENT = {
    "training_event_id": "o.o_orderkey",
    "training_event_name": (
        "CASE WHEN o.o_orderkey % 29 = 0 THEN NULL "
        "ELSE concat('T-', CAST(o.o_orderkey % 211 AS VARCHAR(20))) END"
    ),
    "company_id": "r.r_name",
    "start_date": "CAST(o.o_orderdate AS DATE)",
    "end_date": "CAST(o.o_orderdate + INTERVAL '2' DAY AS DATE)",
    "training_duration": "CAST(1 + o.o_orderkey % 5 AS DECIMAL(10,2))",
    "training_duration_unit": (
        "CASE o.o_orderkey % 10 WHEN 0 THEN 'Week' ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'Day' "
        "ELSE 'Hour' END END"
    ),
}

TRAINING_PARTICIPANT = {
    "training_event_id": "l.l_orderkey",
    "participant_id": "l.l_suppkey",
    "participant_type": (
        "CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_linestatus = 'F' THEN 'Internal' "
        "ELSE 'External' END"
    ),
    "participant_name": "concat('P', CAST(l.l_suppkey AS VARCHAR(20)))",
    "cancel_date": "CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_shipdate AS DATE) END",
}

TRAINING_PARTICIPANT_QRY = {
    "participant_id": "l.l_orderkey",
}

TRAINING_EVENT_COURSE = {
    "training_event_id": "o.o_orderkey",
    "course_id": (
        "CASE WHEN o.o_custkey % 61 = 0 THEN -1 - o.o_custkey % 7 ELSE (o.o_custkey + d.k) % 60 END"
    ),
}

COURSE = {
    "course_id": "p.p_partkey",
    "course_title": "p.p_name",
    "course_category_id": "CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE p.p_type END",
}

COURSE_CATEGORY = {
    "course_category_id": "p.p_type",
    "category_name": "concat('CAT ', p.p_type)",
}

COMPANY_PERS_ASSIGN = {
    "emp_no": "s.s_suppkey",
    "company_id": "r.r_name",
    "org_code": (
        "CASE WHEN s.s_suppkey % 7 = d.k THEN '001' WHEN s.s_suppkey % 11 = 0 THEN NULL "
        "ELSE concat('O', CAST((s.s_suppkey + d.k) % 20 AS VARCHAR(20))) END"
    ),
    "pos_code": "concat('P', CAST((s.s_suppkey * 2 + d.k) % 30 AS VARCHAR(20)))",
    "valid_from": "CASE WHEN d.k = 0 THEN DATE '1995-01-01' ELSE DATE '1998-01-01' END",
    "valid_to": (
        "CASE WHEN d.k = 0 THEN DATE '1998-06-30' WHEN s.s_suppkey % 13 = 0 THEN NULL "
        "ELSE DATE '2001-06-30' END"
    ),
    "is_primary": "CASE WHEN (s.s_suppkey + d.k) % 3 = 0 THEN 1 ELSE 0 END",
}

WORK_SPELL = {
    "emp_no": "s.s_suppkey",
    "company_id": "r.r_name",
    "seq_no": "d.k",
    "site_code": "CAST(s.s_suppkey % 5 AS VARCHAR(20))",
    "start_date": "CASE WHEN d.k = 0 THEN DATE '1995-06-01' ELSE DATE '1998-01-01' END",
    "end_date": (
        "CASE WHEN d.k = 0 THEN DATE '1998-03-31' WHEN s.s_suppkey % 2 = 0 THEN DATE '1999-12-31' "
        "ELSE NULL END"
    ),
}

POSITION_DIM = {
    "company_id": "r.r_name",
    "pos_code": "concat('P', CAST(n.n_nationkey AS VARCHAR(20)))",
    "position_title": "concat('pos ', n.n_name)",
}

ORG_DIM = {
    "company_id": "r.r_name",
    "org_code": "concat('O', CAST(n.n_nationkey AS VARCHAR(20)))",
    "org_name": "concat('org ', n.n_name)",
}

STAFF_GROUP_DIM = {
    "company_id": "r.r_name",
    "site_code": "CAST(n.n_nationkey AS VARCHAR(20))",
    "group_name": "CASE WHEN n.n_nationkey % 2 = 0 THEN 'Mavi Yaka' ELSE 'Beyaz Yaka' END",
}

INTERACTIONS = {
    "ts": "e.ts",
    "question": "concat('q', CAST(e.user_id AS VARCHAR(20)))",
    "generated_sql": (
        "CASE WHEN e.event_type = 'view' AND e.user_id % 7 = 1 THEN '```sql SELECT a FROM t LIMIT 10```' "
        "WHEN e.event_type = 'view' AND e.user_id % 7 = 2 THEN 'SELECT \"a\" FROM \"t\" LIMIT 10;' "
        "ELSE CASE e.event_type WHEN 'view' THEN 'SELECT a FROM t LIMIT 10;' "
        "WHEN 'click' THEN 'select top 5 a from t' WHEN 'signup' THEN 'DELETE FROM t' "
        "WHEN 'error' THEN NULL ELSE 'SELECT a FROM t' END END"
    ),
    "success": "e.event_type <> 'error'",
    "row_count": "CASE WHEN e.event_type = 'error' THEN 0 ELSE CAST(floor(e.value) AS INT) END",
    "error_details": "CASE WHEN e.event_type = 'error' THEN 'ORA-00942' END",
    "app_version": "'1.0.0'",
}

PRODUCT = {
    "id": (
        "CASE WHEN p.p_partkey % 83 = 1 THEN NULL WHEN p.p_partkey % 50 = 2 THEN p.p_partkey - 1 "
        "ELSE p.p_partkey END"
    ),
    "category": "p.p_type",
    "name": "p.p_name",
    "price": "CAST(p.p_retailprice AS DECIMAL(10,2))",
    "stock": "CAST(p.p_size AS BIGINT)",
}

SALE = {
    "id": "l.l_orderkey * 8 + l.l_linenumber",
    "product_id": "CASE WHEN l.l_orderkey % 101 = 0 THEN NULL ELSE l.l_partkey END",
    "quantity": "CAST(l.l_quantity AS BIGINT)",
    "total": "CAST(l.l_extendedprice AS DECIMAL(10,2))",
    "sold_at": "l.l_shipdate",
    "city": "concat('C', CAST(l.l_suppkey % 81 + 1 AS VARCHAR(20)))",
}
