"""Alarm-code dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Alarm code -> message shown to the operator.
ALARM_MESSAGES: dict[str, str] = {
    "0x01001": "OP10 工位：卡料或供料不畅，振动盘频率异常",
    "0x01002": "OP10 工位：传感器信号丢失，光电传感器被油污遮挡",
    "0x01003": "OP10 工位：气源压力过低，未达到0.5MPa标准",
    "0x01004": "OP10 工位：抓取超时，真空吸盘漏气",
    "0x01005": "OP10 工位：Z轴滑台卡滞，异物阻塞",
    "0x01006": "OP10 工位：气道堵塞，供气不畅",
    "0x01007": "OP10 工位：振动盘控制器故障，频率异常",
    "0x01008": "OP10 工位：上料中断，毛坯件供给不足",
    "0x01009": "OP10 工位：真空系统异常，吸附失效",
    "0x0100A": "OP10 工位：供料超时，流水线阻塞",
    "0x03001": "OP30 工位：主轴温度过高，冷却油循环不畅",
    "0x03002": "OP30 工位：主轴轴承磨损，振动值超标",
    "0x03003": "OP30 工位：油路过滤器堵塞，润滑异常",
    "0x03004": "OP30 工位：伺服过载，主轴负载超过120%",
    "0x03005": "OP30 工位：断刀检测报警，钻头断裂",
    "0x03006": "OP30 工位：刀库换刀臂卡死，凸轮箱缺油",
    "0x03007": "OP30 工位：感应开关位置偏移，换刀异常",
    "0x03008": "OP30 工位：主轴皮带松动，张力不足",
    "0x03009": "OP30 工位：电机三相不平衡，阻值误差超标",
    "0x0300A": "OP30 工位：驱动器参数异常，负载限制错误",
    "0x0300B": "OP30 工位：排屑器链条卡死，铁屑堆积",
    "0x0300C": "OP30 工位：油雾器油位过低，润滑不足",
    "0x0300D": "OP30 工位：齿轮箱润滑油过期，需更换",
    "0x0300E": "OP30 工位：主轴空跑振动超标，未低于2.5mm/s",
    "0x0300F": "OP30 工位：进给速度异常，加工精度下降",
    "0x05001": "OP50 工位：相机通讯超时，千兆网线异常",
    "0x05002": "OP50 工位：误检率过高，光源亮度衰减",
    "0x05003": "OP50 工位：镜头脏污，检测精度下降",
    "0x05004": "OP50 工位：背景光干扰，遮光罩未闭合",
    "0x05005": "OP50 工位：视觉控制器软件异常",
    "0x05006": "OP50 工位：IP地址配置错误，通讯失败",
    "0x05007": "OP50 工位：光源控制器电压异常",
    "0x05008": "OP50 工位：图像采集失败，相机离线",
    "0x05009": "OP50 工位：缺陷检测漏判，参数漂移",
    "0x0500A": "OP50 工位：视觉系统重启失败，初始化异常",
    "0x06001": "OP60 工位：机器人原点丢失，电池电压低",
    "0x06002": "OP60 工位：编码器线松动，位置反馈异常",
    "0x06003": "OP60 工位：伺服过载，抓手抓取双工件",
    "0x06004": "OP60 工位：减速机异响，机械部件磨损",
    "0x06005": "OP60 工位：搬运路径异常，碰撞风险",
    "0x06006": "OP60 工位：抓手气缸压力不足",
    "0x06007": "OP60 工位：工件定位失败，偏移超标",
    "0x06008": "OP60 工位：安全回路断开，急停信号触发",
    "0x06009": "OP60 工位：机器人通讯中断，IO信号丢失",
    "0x0600A": "OP60 工位：原点标定失败，需重新校准",
    "0x12001": "OP120 工位：液压系统低压，主油路未达12MPa",
    "0x12002": "OP120 工位：夹紧油路压力不足，低于6MPa",
    "0x12003": "OP120 工位：油缸爬行，内部混入空气",
    "0x12004": "OP120 工位：活塞杆弯曲，动作异常",
    "0x12005": "OP120 工位：导轨润滑不足，摩擦阻力大",
    "0x12006": "OP120 工位：压装不到位，LVDT位移读数偏低",
    "0x12007": "OP120 工位：位移传感器拉杆松动",
    "0x12008": "OP120 工位：比例阀PWM信号干扰，输出异常",
    "0x12009": "OP120 工位：压装力不足，密封圈漏气",
    "0x1200A": "OP120 工位：比例阀阀芯卡滞，响应缓慢",
    "0x1200B": "OP120 工位：液压油位过低，泵站缺油",
    "0x1200C": "OP120 工位：液压管路泄漏，压力下降",
    "0x1200D": "OP120 工位：回油滤芯堵塞，需更换10μm滤芯",
    "0x1200E": "OP120 工位：溢流阀松动，压力漂移",
    "0x1200F": "OP120 工位：保压失败，时间未达2s标准",
    "0x13001": "OP130 工位：焊缝气孔，保护气体流量不足",
    "0x13002": "OP130 工位：工件表面油污，焊接质量差",
    "0x13003": "OP130 工位：激光焦点偏移，需重新校准",
    "0x13004": "OP130 工位：冷水机故障，水温异常",
    "0x13005": "OP130 工位：水路堵塞，激光器冷却异常",
    "0x13006": "OP130 工位：氮气/氩气供给中断，流量低于15L/min",
    "0x13007": "OP130 工位：激光电源异常，输出不稳",
    "0x13008": "OP130 工位：焊接温度过高，热损伤风险",
    "0x13009": "OP130 工位：保护气路堵塞，气压不足",
    "0x1300A": "OP130 工位：激光器复位失败，需重启",
    "0x16001": "OP160 工位：测试泄漏误报，密封圈磨损",
    "0x16002": "OP160 工位：快速接头未插到位，充气异常",
    "0x16003": "OP160 工位：环境温差大，检测结果漂移",
    "0x16004": "OP160 工位：标准件参数丢失，需重新校准",
    "0x16005": "OP160 工位：外部供气中断，气源未开启",
    "0x16006": "OP160 工位：调压阀损坏，气压无法稳定",
    "0x16007": "OP160 工位：充气超时，泄漏率超标",
    "0x16008": "OP160 工位：工装夹具松动，密封不良",
    "0x16009": "OP160 工位：测试压力不足，未达标准值",
    "0x1600A": "OP160 工位：数据采集失败，测试结果丢失",
    "0x17001": "OP170 工位：吸盒失败，真空吸盘磨损",
    "0x17002": "OP170 工位：真空发生器堵塞，过滤器脏污",
    "0x17003": "OP170 工位：真空压力过低，吸附失效",
    "0x17004": "OP170 工位：包装盒供给不足，卡盒",
    "0x17005": "OP170 工位：封箱异常，包装位置偏移",
    "0x17B01": "OP170B 工位：标签贴歪，覆标机构松动",
    "0x17B02": "OP170B 工位：测物电眼灵敏度不足",
    "0x17B03": "OP170B 工位：标签缺料，卷料用尽",
    "0x17B04": "OP170B 工位：标签穿引异常，走纸卡顿",
    "0x17B05": "OP170B 工位：贴标超时，节拍不达标",
    "0x000E1": "产线急停被按下，需顺时针释放",
    "0x000E2": "安全门打开，联锁未闭合",
    "0x000E3": "PLC与上位机通讯故障",
    "0x000E4": "交换机异常，网络中断",
    "0x000E5": "产线总电源异常，电压波动",
}

UNKNOWN_ALARM_PREFIX = "未知错误码: "


def alarm_dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary as a two-column dimension (fixed at 95 rows, so safe to broadcast)."""
    rows = ", ".join(f"('{code}', '{text}')" for code, text in ALARM_MESSAGES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, message)")
